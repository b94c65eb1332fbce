"""Weighted relations: a DataFrame with a weight column `__w` (absent: 1)."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lacuna.catalog import Relationship, SchemaGraph
from lacuna.functions.scalars import uniform
from lacuna.sources.scratch import stored

WEIGHT = "__w"
COMPARE = {"=": operator.eq, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "!=": operator.ne}


def weighted(df: DataFrame) -> DataFrame:
    return df if WEIGHT in df.columns else df.withColumn(WEIGHT, F.lit(1.0))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    df = weighted(df)
    return df.select(*columns, WEIGHT)


def predicate(column: str, op: str, value) -> Column:
    if op == "in":
        return F.col(column).isin(*value)
    return COMPARE[op](F.col(column), F.lit(value))


def where(df: DataFrame, predicates: list[tuple]) -> DataFrame:
    """All predicates hold; null is not a match."""
    return df.filter(reduce(lambda a, b: a & b, (predicate(*p) for p in predicates))) if predicates else df


def join(left: DataFrame, right: DataFrame, r: Relationship, how: str = "inner") -> DataFrame:
    """Foreign key = primary key, whichever side has it; null keys don't match; weights follow the left row."""
    right = right.drop(WEIGHT)
    fk_left = r.fk in left.columns and r.pk in right.columns
    on = left[r.fk] == right[r.pk] if fk_left else left[r.pk] == right[r.fk]
    return left.join(right, on, how)


def join_tables(graph: SchemaGraph, frames: dict[str, DataFrame], relationships: list[Relationship], start: str, how: str = "inner") -> DataFrame:
    out = frames[start]
    for r, new in graph.order(relationships, start):
        out = join(out, frames[new], r, how)
    return out


def extend(graph: SchemaGraph, df: DataFrame, have: set[str], frames: dict[str, DataFrame], relationships: list[Relationship], how: str = "left") -> DataFrame:
    """Joins what the relationships reach, until nothing more is reached."""
    left, have = list(relationships), set(have)
    while r := next((r for r in left if (r.child in have) != (r.parent in have)), None):
        new = r.parent if r.child in have else r.child
        df = join(df, frames[new], r, how)
        have.add(new)
        left.remove(r)
    return df


def concat(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; what a part lacks is null; weights are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(weighted, parts))


def without_partner(child: DataFrame, parent: DataFrame, r: Relationship) -> DataFrame:
    return parent.join(child, parent[r.pk] == child[r.fk], "left_anti")


def in_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col(keys.columns[0]).alias("__k")), F.col(column) == F.col("__k"), "left_semi")


def not_in_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col(keys.columns[0]).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def unknown_tf(parents: DataFrame, r: Relationship, known: DataFrame) -> DataFrame:
    """The tuple factor becomes null for parents outside `known`."""
    k = known.select(F.col(known.columns[0]).alias("__k")).distinct().withColumn("__known", F.lit(True))
    out = parents.join(k, F.col(r.pk) == F.col("__k"), "left")
    return out.withColumn(r.tf, F.when(F.col("__known"), F.col(r.tf))).drop("__k", "__known")


def cut_links(child: DataFrame, r: Relationship, removed: DataFrame) -> DataFrame:
    """Foreign keys to removed parents become null."""
    gone = removed.select(F.col(removed.columns[0]).alias("__k")).distinct()
    out = child.join(gone, F.col(r.fk) == F.col("__k"), "left")
    return out.withColumn(r.fk, F.when(F.col("__k").isNull(), F.col(r.fk))).drop("__k")


def connected(df: DataFrame, tfs: list[str]) -> DataFrame:
    """Without rows whose tuple factors are 0 in all the relationships."""
    if not tfs:
        return df
    return df.filter(~reduce(lambda a, b: a & b, (F.coalesce(F.col(t) == 0, F.lit(False)) for t in tfs)))


def connected_on_path(df: DataFrame, relationships: list[Relationship], tables: set[str]) -> DataFrame:
    """connected(), for the relationships whose tables all lie on a path."""
    return connected(df, [r.tf for r in relationships if {r.child, r.parent} <= tables and r.tf in df.columns])


def sentinel_to_null(df: DataFrame, sentinels: dict[str, object]) -> DataFrame:
    """For each column its sentinel becomes null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in sentinels.items()})


def sample_with_replacement(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """About `rows` rows; a row may come several times: its number of times is a Poisson draw by the hash of its key."""
    mean = rows / max(1, df.count())
    if mean <= 0:
        return df.limit(0)
    times, total = [], 0.0
    for k in range(int(mean + 12 * mean**0.5 + 12)):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        times.append(total)
    u = uniform(seed, "again", F.col(key))
    n = F.size(F.filter(F.array(*map(F.lit, times)), lambda x: x <= u))
    return df.withColumn("__n", n).filter("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__i")


def first_rows(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """The `rows` rows (the limit is the feature) with the least hash of their key."""
    return df.orderBy(uniform(seed, "first", F.col(key)), key).limit(rows)


def running_total(df: DataFrame, amount: str, order: str, group: str | None = None, name: str = "running") -> DataFrame:
    """The sum of `amount` up to each row, within a group or over all rows."""
    if group:
        w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(amount).over(w))
    return running_totals(df, {name: amount}, [order])


def running_totals(df: DataFrame, amounts: dict[str, str], order: list[str | Column]) -> DataFrame:
    """The sums (name: amount) up to each row, rows in ranges of `order`, whose totals alone meet in one task."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "running")
    totals = parts.groupBy("__part").agg(*[F.sum(a).alias(f"__sum_{n}") for n, a in amounts.items()])  # a row a range
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__part", *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in amounts])
    w = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(before), "__part")
    return out.withColumns({n: F.col(f"__before_{n}") + F.sum(a).over(w) for n, a in amounts.items()}).drop("__part", *[f"__before_{n}" for n in amounts])


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """A dense number from 0 by columns that no two rows share, without one task for all."""
    return running_totals(df.withColumn("__one", F.lit(1).cast("long")), {name: "__one"}, order).withColumn(name, F.col(name) - 1).drop("__one")


def cut_batch(df: DataFrame, amount: str, order: str, most: float) -> DataFrame:
    """The rows, in their order, whose amounts add up to at most `most`."""
    return running_total(df, amount, order, name="__running").filter(F.col("__running") <= most).drop("__running")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def union_combine(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Branches with the tuple factor of their last relationship: a branch keeps what all earlier ones can't reach (factor 0)."""
    out = []
    for i, (df, _) in enumerate(parts):
        for _, tf in parts[:i]:
            df = df.filter(F.col(tf) == 0)
        out.append(df)
    return concat(*out)


def union_scale_up(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """The first branch alone, its weights scaled to the sum of all branches."""
    total = union_combine(parts).agg(F.sum(WEIGHT).alias("__all"))
    first = weighted(parts[0][0])
    own = first.agg(F.sum(WEIGHT).alias("__own"))
    scale = total.crossJoin(own).select(F.coalesce(F.try_divide(F.col("__all"), F.col("__own")), F.lit(1.0)).alias("__s"))
    return first.crossJoin(F.broadcast(scale)).withColumn(WEIGHT, F.col(WEIGHT) * F.col("__s")).drop("__s")  # one row of one number
