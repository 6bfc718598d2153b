"""Leaks of evaluation lineages into training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def root(record_id: str = "record_id", lineage: str = "lineage_root_id"):
    return F.coalesce(F.col(lineage), F.col(record_id))


def leaked(df: DataFrame, split: str = "split") -> DataFrame:
    """Training rows whose lineage root is also the root of an evaluation row."""
    held = df.where(F.col(split) == "eval").select(root().alias("__root")).distinct()
    return df.where(F.col(split) == "train").withColumn("__root", root()).join(held, "__root", "left_semi").drop("__root")


def without_leaks(df: DataFrame, split: str = "split") -> DataFrame:
    """All rows but the leaked training rows: every one of them goes, by an anti-join, and evaluation rows stay."""
    held = df.where(F.col(split) == "eval").select(root().alias("__root")).distinct()
    kept = df.where(F.col(split) == "train").withColumn("__root", root()).join(held, "__root", "left_anti").drop("__root")
    return kept.unionByName(df.where(~F.col(split).eqNullSafe("train")))


def summary(df: DataFrame, split: str = "split") -> DataFrame:
    """(eval_root_count, leaked_train_row_count, leaked_examples, is_lineage_clean); the examples are the ten smallest ids."""
    bad = leaked(df, split)
    roots = df.where(F.col(split) == "eval").agg(F.count_distinct(root()).alias("eval_root_count"))
    first = bad.select("record_id").distinct().orderBy("record_id").limit(10).agg(F.sort_array(F.collect_list("record_id")).alias("leaked_examples"))
    return roots.crossJoin(bad.agg(F.count(F.lit(1)).alias("leaked_train_row_count"))).crossJoin(first).withColumn("is_lineage_clean", F.col("leaked_train_row_count") == 0)  # one row each
