"""Sinks: JSON lines with sorted keys, CSV with a union of columns, Parquet by split, and small driver documents."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def sorted_struct(c: Column, kind: T.DataType) -> Column:
    """A struct with its fields, and those of nested structs and arrays of structs, in name order."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sorted_struct(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: sorted_struct(x, kind.elementType))
    return c


def json_line(df: DataFrame) -> Column:
    """The row as JSON with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[sorted_struct(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"})


def ascii_only(line: Column) -> Column:
    """JSON text with every character beyond ASCII as an escape, those beyond the basic plane as two."""
    units = F.regexp_extract_all(F.hex(F.encode(line, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    plain = lambda u: F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")
    escaped = F.array_join(F.transform(units, lambda u: F.when(u < "0080", plain(u)).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")
    return F.when(line.rlike(r"[^\x00-\x7f]"), escaped).otherwise(line)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of JSON-lines parts, keys sorted, nulls kept, ASCII only; with ``order`` they are range-partitioned, so their names follow the order."""
    out = df.select(ascii_only(json_line(df)).alias("value"), *(order or []))
    (out.orderBy(*order).select("value") if order else out).write.mode("overwrite").text(path)


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    """CSV under the union of all columns; nested values as JSON."""
    flat = [f.select(*[F.to_json(c.name).alias(c.name) if isinstance(c.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c.name) for c in f.schema.fields]) for f in frames]
    out = flat[0]
    for f in flat[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True)


def export(canonical: DataFrame, directory: str) -> dict[str, str]:
    """The four products of a build: canonical rows (Parquet by split), prompt and completion, messages, evaluation manifest."""
    paths = {k: f"{directory}/{k}" for k in ("canonical", "sft_prompt_completion", "sft_messages", "eval_manifest")}
    canonical.write.mode("overwrite").partitionBy("split").parquet(paths["canonical"])
    stored = canonical.sparkSession.read.parquet(paths["canonical"])
    train = stored.where("split = 'train'")
    write_jsonl(prompt_completion(train), paths["sft_prompt_completion"])
    write_jsonl(chat_rows(train), paths["sft_messages"])
    write_jsonl(eval_manifest(stored.where("split = 'eval'")), paths["eval_manifest"])
    return paths


def write_mixes(rows: DataFrame, directory: str, mix: str = "mix_name", order: str = "record_id") -> dict[str, str]:
    """Every mix of a frame of few mixes as a folder of JSON lines of its own: mix -> path. All go in one job."""
    stored = rows.select(mix, order, ascii_only(json_line(rows)).alias("value"))
    stored.repartitionByRange(mix, order).sortWithinPartitions(mix, order).select(mix, "value").write.mode("overwrite").partitionBy(mix).text(directory)
    return {r[0]: f"{directory}/{mix}={r[0]}" for r in rows.select(mix).distinct().collect()}


def payload_json(target: Column, kind: T.DataType) -> Column:
    return F.to_json(sorted_struct(target, kind), {"ignoreNullFields": "false"})


def prompt_completion(df: DataFrame) -> DataFrame:
    return df.select("record_id", X.prompt(F.col("input_text")).alias("prompt"), payload_json(F.col("target"), df.schema["target"].dataType).alias("completion"))


def chat_rows(df: DataFrame) -> DataFrame:
    return df.select("record_id", X.messages(F.col("input_text"), payload_json(F.col("target"), df.schema["target"].dataType)).alias("messages"))


def eval_manifest(df: DataFrame) -> DataFrame:
    return df.select("record_id", "split", "source_dataset", "input_text", F.col("target").alias("reference_payload"), payload_json(F.col("target"), df.schema["target"].dataType).alias("reference_json"), X.prompt(F.col("input_text")).alias("prompt"), X.messages(F.col("input_text")).alias("messages"), "metadata")


def write_document(path: str, payload: dict | str) -> str:
    """A small document on the driver, written beside its place and moved there."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_name(p.name + ".part")
    part.write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=2, sort_keys=True) + "\n")
    os.replace(part, p)
    return str(p)


def mirror(source: str, destination: str, most: int = 1_000_000) -> str:
    """Copy a file of at most ``most`` bytes; a larger one is an error."""
    if os.path.getsize(source) > most:
        raise ValueError(f"{source} is larger than {most} bytes")
    Path(destination).parent.mkdir(parents=True, exist_ok=True)
    return shutil.copy2(source, destination)


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A report table of a result that is small by nature; more rows than ``most`` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]]) + "\n"
