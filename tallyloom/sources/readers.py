"""Scans: strict JSON lines, header CSV, JSON documents and step checkpoints."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import exists


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under an explicit schema, with the raw line in ``raw``; blank lines are skipped.

    A line that is not a JSON object fails the query when it is read (``strict``) or gives a row of nulls. Keys that the
    schema does not name are ignored; the raw line still holds them.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"))
    parsed = lines.withColumn("row", F.from_json("raw", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>").isNotNull())
    if strict:
        parsed = parsed.withColumn("row", F.when(F.col("ok"), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 200)))))
    return parsed.select("row.*", "raw")


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Like read_jsonl; an absent file gives no rows."""
    if not exists(spark, path if "://" in path or path.startswith("file:") else os.path.abspath(path)):
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], T.StructType([*fields.fields, T.StructField("raw", T.StringType())]))
    return read_jsonl(spark, path, schema)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: all strings, quoted line breaks allowed, empty cells are empty strings or null, never the text "null". Header names become snake_case."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    return rows.toDF(*["_".join("".join(ch if ch.isalnum() else " " for ch in c.lower()).split()) for c in rows.columns])


def read_json_document(path: str, default: dict | None = None) -> dict | None:
    """A small JSON document on the driver; ``default`` if the file is absent."""
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else default


def read_step_checkpoints(spark: SparkSession, directory: str, schema: T.StructType | str) -> DataFrame:
    """One row per step file, unreadable files left out, with ``checkpoint_path``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(directory).select("*", F.col("_metadata.file_path").alias("checkpoint_path"))


def bundle_from_steps(steps: DataFrame, config_family: str = "config_search") -> dict[str, DataFrame]:
    """The row kinds of a partial run: summaries, configuration search, correctness and raw rows."""
    summary = steps.where("summary_row is not null").select("step_id", "experiment_family", "summary_row.*")
    out = {"summary_rows": summary.where(F.col("experiment_family") != config_family), "config_rows": summary.where(F.col("experiment_family") == config_family), "raw_rows": steps.select("step_id", F.inline("raw_rows"))}
    if "correctness_row" in steps.columns:
        out["correctness_rows"] = steps.where("correctness_row is not null").select("step_id", "correctness_row.*")
    return out


def first_existing(candidates: list[str | None]) -> str | None:
    """The first candidate path that exists, duplicates tried once."""
    return next((c for c in dict.fromkeys(c for c in candidates if c) if os.path.exists(c)), None)
