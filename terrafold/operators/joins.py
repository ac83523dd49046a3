"""One-to-one joins that report what does not match instead of dropping it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import number
from ..session import materialise


class AlignmentError(ValueError):
    """Two tables do not hold the same ids or values."""


def id_mismatches(left: DataFrame, right: DataFrame, key: str = "sample_id", compare: Sequence[str] = ()) -> DataFrame:
    """One row: duplicate ids on each side, ids on one side only, and differing values.

    Both sides are reduced to one record per id before the full join, so a repeated id
    stays one record.
    """

    def per_id(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("k")).agg(
            F.count(F.lit(1)).alias(f"{side}_n"),
            *[F.min(F.col(c).cast("string")).alias(f"{side}_{c}") for c in compare],
        )

    both = per_id(left, "l").join(per_id(right, "r"), "k", "full_outer")
    matched = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    return both.agg(
        F.count_if(F.col("l_n") > 1).alias("left_duplicates"),
        F.count_if(F.col("r_n") > 1).alias("right_duplicates"),
        F.count_if(F.col("r_n").isNull()).alias("left_only"),
        F.count_if(F.col("l_n").isNull()).alias("right_only"),
        *[F.count_if(matched & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"differing_{c}") for c in compare],
    )


def require_match(mismatches: DataFrame) -> None:
    row = mismatches.first().asDict()
    wrong = {k: v for k, v in row.items() if v}
    if wrong:
        raise AlignmentError(f"tables do not match: {wrong}")


def attach_manifest(
    data: DataFrame,
    manifest: DataFrame,
    key: str = "sample_id",
    not_copied: Sequence[str] = ("site_id", "date", "weather_event_id", "manifest_version"),
) -> DataFrame:
    """Add the manifest's assignment columns, one manifest row to each data row.

    A repeated id on either side, or a data row that the manifest does not know, is refused; ``attachment_faults`` counts them.
    """
    faults = {k: v for k, v in attachment_faults(data, manifest, key).first().asDict().items() if v}
    if faults:
        raise AlignmentError(f"the manifest cannot be attached: {faults}")
    assigned = [c for c in manifest.columns if c != key and c not in not_copied]
    base = data.drop(*[c for c in assigned if c in data.columns])
    return base.join(manifest.select(key, *assigned), key, "left")


def attachment_faults(data: DataFrame, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: repeated ids of the data and of the manifest, and data ids without manifest row, from one aggregate."""
    def side(df: DataFrame, at: int) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("k"), *[F.lit(int(i == at)).alias(n) for i, n in enumerate(("d", "m"))])

    per_id = side(data, 0).unionByName(side(manifest, 1)).groupBy("k").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    return per_id.agg(
        F.count_if(F.col("d") > 1).alias("repeated_data_ids"), F.count_if(F.col("m") > 1).alias("repeated_manifest_ids"),
        F.count_if((F.col("d") > 0) & ((F.col("m") == 0) | F.col("k").isNull())).alias("unassigned_ids"))


def unassigned_rows(attached: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: null count of each assignment column."""
    return attached.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def align(manifest: DataFrame, data: DataFrame, key: str = "sample_id") -> DataFrame:
    """Manifest rows of the ids in ``data``; row order is not part of the contract."""
    return manifest.join(data.select(key), key, "left_semi")


def reindex(predictions: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """Stored predictions on the wanted ids, null where none is stored."""
    return ids.select(key).join(predictions, key, "left")


def label_differences(predictions: DataFrame, observations: DataFrame, label: str, key: str = "sample_id",
                      relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """One row: matched ids and labels that differ beyond the tolerance (missing equals missing)."""
    left = predictions.select(key, number(label).alias("stored"))
    right = observations.select(key, number(label).alias("current"))
    same = same_value("stored", "current", relative, absolute)
    return left.join(right, key).agg(F.count(F.lit(1)).alias("matched"), F.count_if(~same).alias("differing"))


def same_value(stored: str, current: str, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Equal (infinities too), both missing, or within the tolerance."""
    a, b = F.col(stored), F.col(current)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return a.eqNullSafe(b) | F.coalesce(finite & (F.abs(a - b) <= absolute + relative * F.abs(b)), F.lit(False))


def join_predictions(predictions: DataFrame, observations: DataFrame, key: str = "sample_id",
                     label: str | None = None) -> DataFrame:
    """One-to-one join after the id sets and the labels are found equal.

    One full outer join, written once, gives the counts, the label check and the result.
    """
    repeated = [c for c in predictions.columns if c != key and c in observations.columns]
    compared = bool(label) and label in predictions.columns and label in observations.columns
    left = predictions.withColumn("__stored", number(label) if compared else F.lit(None).cast("double")).drop(*repeated)
    left = left.withColumn("__l", F.lit(True))
    right = observations.withColumn("__current", number(label) if compared else F.lit(None).cast("double")).withColumn("__r", F.lit(True))
    both = materialise(left.join(right, key, "full_outer"), "predictions")
    totals = both.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__l").isNull()).alias("right_only"),
                                      F.count_if(F.col("__r").isNull()).alias("left_only"),
                                      F.count_if(F.col("__l") & F.col("__r") & ~same_value("__stored", "__current")).alias("differing"))
    found = totals.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("left_only").alias("left_only"),
                       F.sum("right_only").alias("right_only"), F.sum("differing").alias("differing_labels")).first().asDict()
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise AlignmentError(f"tables do not match: {wrong}")
    return both.drop("__stored", "__current", "__l", "__r")


def merge_predictions(core: DataFrame, enhanced: DataFrame, key: str = "sample_id") -> DataFrame:
    """Full outer merge of two prediction tables; a shared column keeps the first value."""
    shared = [c for c in enhanced.columns if c in core.columns and c != key]
    renamed = enhanced.withColumnsRenamed({c: f"__{c}" for c in shared})
    merged = core.join(renamed, key, "full_outer")
    return merged.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in shared}).drop(
        *[f"__{c}" for c in shared]
    ) if shared else merged


def only_in_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first table that the second lacks."""
    return first.select(key).distinct().join(second.select(key), key, "left_anti")


def in_both(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both tables."""
    return first.select(key).distinct().join(second.select(key), key, "left_semi")
