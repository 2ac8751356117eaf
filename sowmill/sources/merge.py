"""Upsert, field merge and delete over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Newest row per key, a null order being the oldest. max_by combines on the map side, so a hot key costs one row per task."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(order)).alias("_r")).select("_r.*")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Target with the rows of the batch put in; the newest row per key wins over both, the batch where they are equal.

    Batches may come out of order: a row that is older than the target's is
    dropped. The target, one row per key, is looked up by the keys of the batch
    and not regrouped, so it is not shuffled when Spark can broadcast the batch.
    """
    new = latest_per_key(batch, key, order).withColumn("_new", F.struct(order))
    met = target.withColumn("_old", F.struct(order)).join(new.select(F.col(key).alias("_k"), "_new"), F.col(key) == F.col("_k"), "left")
    newer = F.coalesce(F.col("_old") > F.col("_new"), F.lit(False))
    kept = met.where(F.col("_k").isNull() | newer).select(*target.columns)
    beaten = met.where(newer).select(F.col("_k").alias(key))
    return kept.unionByName(new.join(beaten, key, "left_anti").select(*target.columns))


def merge_field(target: DataFrame, patch: DataFrame, key: str, field: str, drop: list[str] | None = None) -> DataFrame:
    """Replace one field where the patch has a value; drop legacy fields. One patch row per key is expected."""
    p = patch.select(F.col(key).alias("_pk"), F.col(field).alias("_pv"))
    out = target.join(p, F.col(key) == F.col("_pk"), "left").withColumn(field, F.coalesce("_pv", field))
    return out.drop("_pk", "_pv", *(drop or []))


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")
