"""Staging of source files that are not there yet: downloads, archives and hub connectors, off unless a caller asks for them.

These run on the driver before a scan is planned; what they leave behind is a file that any scan reads.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import urllib.request
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .readers import read_csv, read_jsonl
from .registry import Source, resolve

#: Hub name -> function (uri, split) -> path of a file with the rows as JSON lines.
HUBS: dict[str, Callable[[str, str | None], str]] = {}


def member(archive: str, name: str | None = None) -> str:
    """The named member of a zip archive, else its first CSV file in name order."""
    with zipfile.ZipFile(archive) as z:
        files = z.namelist()
    found = name if name in files else next((f for f in sorted(files) if f.lower().endswith(".csv")), None) if name is None else None
    if found is None:
        raise FileNotFoundError(f"{archive} has no {name or 'CSV file'}")
    return found


def download(url: str, destination: str, archive_member: str | None = None, timeout: float = 60.0) -> str:
    """Fetch ``url`` to ``destination``; of a zip archive the member, and the archive is removed. A half-fetched file never takes the place."""
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    with tempfile.TemporaryDirectory(dir=os.path.dirname(destination) or ".") as work:
        part = os.path.join(work, "part")
        with urllib.request.urlopen(url, timeout=timeout) as response, open(part, "wb") as out:
            shutil.copyfileobj(response, out)
        if url.lower().endswith(".zip") or archive_member:
            with zipfile.ZipFile(part) as z, z.open(member(part, archive_member)) as inside, open(os.path.join(work, "member"), "wb") as out:
                shutil.copyfileobj(inside, out)
            part = os.path.join(work, "member")
        os.replace(part, destination)
    return destination


def stage(source: Source, path: str) -> None:
    """A ``fetch`` for :func:`registry.resolve`: the source's ``download_url``, or its hub connector."""
    if url := source.extra.get("download_url"):
        download(url, path, source.extra.get("archive_member_name"))
    elif source.source_type == "huggingface" and "huggingface" in HUBS:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        shutil.copyfile(HUBS["huggingface"](source.source_uri_or_path, source.hf_split), path)


def source_rows(spark: SparkSession, source: Source, schema: str, repo_root: str, raw_root: str | None = None, prefer_fixtures: bool = False, allow_fixtures: bool = False, fetch=None) -> tuple[DataFrame | None, str | None, bool]:
    """(rows, path, is it a fixture) of a source: CSV by type or suffix, else JSON lines under ``schema``; no rows for generated sources."""
    path, fixture = resolve(source, repo_root, raw_root, prefer_fixtures, allow_fixtures, fetch)
    if path is None:
        return None, None, False
    return (read_csv(spark, path) if source.source_type == "local_csv" or path.endswith(".csv") else read_jsonl(spark, path, schema)), path, fixture
