"""Ranking, paging, deduplication and list numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group with their rank.

    ``row_number <= k`` lets Spark cut each group inside the map tasks, so a hot
    group sends k rows per task over the network.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def rank_score(df: DataFrame, group: list[str], order: list[Column], k: int = 50) -> DataFrame:
    """Rank from 1 and the positional score 1 - 0.1 x (rank - 1), in hundredths exact."""
    ranked = top_per_group(df, group, order, k)
    return ranked.withColumn("rank_score", (F.lit(1).cast("decimal(10,2)")
                                            - (F.col("rank") - 1) * F.lit("0.1").cast("decimal(4,2)")).cast("double"))


def page(df: DataFrame, order: list[Column], top: int, skip: int = 0) -> DataFrame:
    """One page of results with ``total_count``; the order must end with a unique column."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(*order).offset(skip).limit(top).withColumn("total_count", total.scalar())


def order_by(df: DataFrame, field: str, key: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(field).desc() if descending else F.col(field).asc(), key)


def merge_strategies(parts: list[tuple[str, float, DataFrame]], key: str, top: int) -> DataFrame:
    """Union of strategy results in priority order: the first strategy that finds an id owns it."""
    frames = [df.select(key, F.lit(i).alias("priority"), F.lit(name).alias("search_strategy"),
                        F.lit(float(score)).alias("strategy_score")) for i, (name, score, df) in enumerate(parts)]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    owner = F.struct("priority", "search_strategy", "strategy_score")
    return (union.groupBy(key).agg(F.min_by(owner, F.col("priority")).alias("_o")).select(key, "_o.*")
            .orderBy(F.col("strategy_score").desc(), "priority", key).limit(top))


def dedup_best(df: DataFrame, name: str, key: str, score: str) -> DataFrame:
    """Best row per file name (id where the name is blank); the smaller id wins a tie."""
    row = F.struct(*df.columns)
    group = F.coalesce(F.nullif(F.trim(F.col(name).cast("string")), F.lit("")), F.col(key).cast("string"))
    return (df.groupBy(group.alias("_g"))
            .agg(F.min_by(row, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("_r")).select("_r.*"))


def dedup_first(df: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """First row per file name in the given order."""
    row = F.struct(*df.columns)
    group = F.coalesce(F.nullif(F.trim(F.col(name).cast("string")), F.lit("")), F.col(key).cast("string"))
    return df.groupBy(group.alias("_g")).agg(F.min_by(row, F.struct(order, key)).alias("_r")).select("_r.*")


def numbered_items(df: DataFrame, keep: list[str], items: str, placeholder: str) -> DataFrame:
    """One row per list item, numbered from 1; an empty list gives one placeholder row without a number."""
    return (df.select(*keep, F.posexplode_outer(items).alias("_i", "_x"))
            .select(*keep, F.coalesce("_x", F.lit(placeholder)).alias("item"), (F.col("_i") + 1).alias("item_number")))


def top_terms(counts: DataFrame, k: int, minimum: int = 1) -> DataFrame:
    """Most common terms of every kind (kind, term, n) with a minimum count."""
    return top_per_group(counts.where(F.col("n") >= minimum), ["kind"], [F.col("n").desc(), F.col("term")], k)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def staffing_detail(sow: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """One row per person with hours and percent read from the allocation text; a placeholder where there is none.

    The staffing lines stay long, so a SOW of any size spreads over tasks.
    """
    from sowmill.functions.scalars import allocation_columns

    rows = lines.withColumn("_a", allocation_columns(F.col("allocation"))).withColumn("_has", F.lit(True))
    joined = sow.join(rows, key, "left")
    blank = F.lit("")
    return joined.select(
        *sow.columns,
        F.when(F.col("_has"), F.coalesce("name", F.lit("N/A"))).otherwise("No staffing data available").alias("person_name"),
        F.when(F.col("_has"), F.coalesce("role", F.lit("N/A"))).otherwise(blank).alias("role"),
        F.coalesce("allocation", blank).alias("allocation"),
        F.coalesce("_a.hours", blank).alias("hours"), F.coalesce("_a.percentage", blank).alias("percentage"))
