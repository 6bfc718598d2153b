"""The dataset build: adapt, enforce policy, sample by weight, augment, cap, remove leaks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment, lineage, sampling
from ..sources import adapters
from ..sources.registry import Source, weight
from ..storage import written


@dataclass(frozen=True)
class Profile:
    seed: int = 17
    eval_ratio: float = 0.2
    train_target: int | None = None
    eval_target: int | None = None
    max_source_share: float | None = 0.45
    max_synthetic_share: float = 0.30
    eval_allow_synthetic: bool = False
    augment: bool = True
    group_weights: dict = field(default_factory=dict)
    weight_overrides: dict = field(default_factory=dict)


def eval_policy(df: DataFrame, allow_synthetic: bool) -> DataFrame:
    """Synthetic rows may not be evaluation rows unless allowed."""
    return df if allow_synthetic else df.where(~((F.col("split") == "eval") & F.coalesce(F.col("metadata.synthetic"), F.lit(False))))


def intake(pairs: list[tuple[Source, DataFrame]], profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects) of raw source frames: adapted, split, and without synthetic evaluation rows unless they are allowed."""
    accepted, refused = None, None
    for source, df in pairs:
        drafts = adapters.adapt(source.adapter_name, df)
        a, r = adapters.canonical(drafts, source, profile.eval_ratio), adapters.rejects(drafts, source.adapter_name)
        accepted, refused = (a, r) if accepted is None else (accepted.unionByName(a), refused.unionByName(r))
    return eval_policy(accepted, profile.eval_allow_synthetic), refused


def build(raw: dict[Source, DataFrame] | list[tuple[Source, DataFrame]], profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejects) of raw source frames; rows are written to the shared folder after adaptation and once more before leaks are removed."""
    pairs = list(raw.items()) if isinstance(raw, dict) else raw
    accepted, refused = intake(pairs, profile)
    rows = written(accepted, "accepted")
    weights = {s.dataset_name: weight(s, profile.weight_overrides, profile.group_weights) for s, _ in pairs}
    train = sampling.weighted_sample(rows.where("split = 'train'"), "source_dataset", "record_id", profile.train_target, weights, profile.max_source_share, profile.seed)
    held = sampling.weighted_sample(rows.where("split = 'eval'"), "source_dataset", "record_id", profile.eval_target, weights, profile.max_source_share, profile.seed + 100)
    if profile.augment:
        base = train.select("record_id", "split", "source_dataset", "input_text", "target", F.col("metadata.lineage_root_id").alias("lineage_root_id"))
        more = augment.augmented(base)
        kinds = {f.name: f.dataType for f in rows.schema["metadata"].dataType}
        given = {
            "source_group": F.lit("synthetic_augmentation_data"), "source_type": F.lit("generated"), "source_record_id": F.col("record_id"),
            "source_uri_or_path": F.lit(f"generated://{augment.SOURCE}"), "adapter_name": F.lit(augment.SOURCE),
            "license_note": F.lit("Generated train-only augmentation derived from accepted canonical task rows."),
            "synthetic": F.lit(True), "augmentation_kind": F.col("augmentation_kind"), "parent_record_id": F.col("parent_record_id"), "lineage_root_id": F.col("lineage_root_id"),
            "split_origin": F.lit("parent"), "mapping_version": F.lit("v1"), "ingested_at_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "raw_hash": F.col("raw_hash"), "augmentation_index": F.col("augmentation_index"),
        }
        meta = F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
        train = train.unionByName(more.select("record_id", "split", "source_dataset", "input_text", F.col("target").cast(rows.schema["target"].dataType).alias("target"), meta.alias("metadata")))
        # The cap is decided on ids alone; texts of variants that it drops are never written.
        ids = written(train.select("record_id", F.coalesce(F.col("metadata.synthetic"), F.lit(False)).alias("synthetic")), "variants")
        kept = sampling.cap_synthetic(ids, "synthetic", "record_id", profile.max_synthetic_share, profile.seed + 200)
        train = train.join(kept.select("record_id").distinct(), "record_id", "left_semi")
    both = written(train.unionByName(held).withColumn("lineage_root_id", F.col("metadata.lineage_root_id")), "canonical")
    return lineage.without_leaks(both).drop("lineage_root_id"), refused
