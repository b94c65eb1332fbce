"""Tuple factors: how many child rows a parent has, had, and should have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.catalog import Relationship

CURRENT = "__current_tf"


def add_tf(parents: DataFrame, children: DataFrame, r: Relationship, name: str | None = None, sample_rate: float = 1.0) -> DataFrame:
    """The number of children of each parent, 0 if none, by the share of children that the table holds."""
    n = children.filter(F.col(r.fk).isNotNull()).groupBy(F.col(r.fk).alias("__k")).agg(F.count("*").alias("__n"))
    count = F.coalesce("__n", F.lit(0).cast("long"))
    count = count if sample_rate == 1 else (count / sample_rate)
    return parents.join(n, F.col(r.pk) == F.col("__k"), "left").withColumn(name or r.tf, count).drop("__k", "__n")


def add_current_tf(parents: DataFrame, children: DataFrame, r: Relationship) -> DataFrame:
    return add_tf(parents, children, r, CURRENT)


def percentiles(df: DataFrame, tf: str, at=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0)) -> DataFrame:
    return df.agg(*[F.percentile(tf, F.lit(p)).alias(f"p{int(round(p * 100))}") for p in at], F.avg(tf).alias("mean"))


def expected_appearance(tf: Column, appearance: Column, current: Column) -> Column:
    """tf times how often a present child appears; 0 for a factor of 0; factor 1 where no child is present."""
    times = F.when(current.isNull() | (current == 0), F.lit(1.0)).otherwise(F.try_divide(appearance, current))
    return F.when(tf == 0, F.lit(0.0)).otherwise(tf * times)
