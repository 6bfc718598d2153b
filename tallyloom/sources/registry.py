"""The source registry: typed entries, path templates, selection, weights, and resolution with fallback."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

TYPES = ("huggingface", "local_jsonl", "local_csv", "generated")
GROUPS = ("domain_task_data", "schema_discipline_data", "synthetic_augmentation_data")


@dataclass(frozen=True)
class Source:
    dataset_name: str
    source_type: str
    source_uri_or_path: str
    adapter_name: str
    source_group: str
    license_note: str = ""
    default_inclusion_weight: float = 1.0
    enabled_by_default: bool = True
    source_notes: str = ""
    hf_split: str | None = None
    local_fixture_path: str | None = None
    extra: dict = field(default_factory=dict)

    def path(self, repo_root: str, raw_root: str | None = None) -> str:
        return os.path.abspath(self.source_uri_or_path.replace("{repo_root}", repo_root).replace("{raw_root}", raw_root or repo_root))


def registry(entries: list[dict]) -> list[Source]:
    """Typed entries; duplicate names and unknown types or groups are errors, unknown keys go to ``extra``."""
    known, out = {f.name for f in fields(Source)} - {"extra"}, []
    for e in entries:
        s = Source(**{k: v for k, v in e.items() if k in known}, extra={k: v for k, v in e.items() if k not in known})
        if s.source_type not in TYPES or s.source_group not in GROUPS:
            raise ValueError(f"{s.dataset_name}: unknown type or group")
        if any(s.dataset_name == o.dataset_name for o in out):
            raise ValueError(f"{s.dataset_name} is registered twice")
        out.append(s)
    return out


def load_registry(path: str) -> list[Source]:
    """The entries below ``sources`` of a YAML document."""
    from ..plans.documents import load_yaml

    return registry(load_yaml(path).get("sources") or [])


def registry_frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    names = [f.name for f in fields(Source) if f.name not in ("extra", "hf_split", "local_fixture_path")]
    return spark.createDataFrame([tuple(getattr(s, n) for n in names) for s in sources], "dataset_name string, source_type string, source_uri_or_path string, adapter_name string, source_group string, license_note string, default_inclusion_weight double, enabled_by_default boolean, source_notes string")


def active(sources: list[Source], include: set[str] = frozenset(), exclude: set[str] = frozenset(), include_groups: set[str] = frozenset(), schema_discipline: bool = False) -> list[Source]:
    """Sources to read: never an excluded one, schema-discipline sources only when asked for, else enabled or included ones."""
    return [
        s
        for s in sources
        if s.dataset_name not in exclude
        and (s.source_group != "schema_discipline_data" or schema_discipline or s.dataset_name in include)
        and (s.enabled_by_default or s.dataset_name in include or s.source_group in include_groups)
    ]


def weight(s: Source, overrides: dict[str, float] | None = None, group_weights: dict[str, float] | None = None) -> float:
    return (overrides or {}).get(s.dataset_name, s.default_inclusion_weight) * (group_weights or {}).get(s.source_group, 1.0)


def resolve(s: Source, repo_root: str, raw_root: str | None = None, prefer_fixtures: bool = False, allow_fixtures: bool = False, fetch=None) -> tuple[str | None, bool]:
    """(path, is it a fixture): None for generated sources. ``fetch(source, path)`` may stage a missing file; without any file it is an error.

    Hub and HTTP connectors are staging steps outside Spark; give them as ``fetch``.
    """
    fixture = s.local_fixture_path and os.path.join(repo_root, s.local_fixture_path)
    if s.source_type == "generated":
        return None, False
    if prefer_fixtures and fixture and os.path.exists(fixture):
        return fixture, True
    target = s.path(repo_root, raw_root)
    if not os.path.exists(target) and fetch is not None:
        fetch(s, target)
    if os.path.exists(target):
        return target, False
    if allow_fixtures and fixture and os.path.exists(fixture):
        return fixture, True
    raise FileNotFoundError(f"{s.dataset_name}: {target}")
