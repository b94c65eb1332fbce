"""Biased removal of rows: complete data made incomplete, by hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.catalog import Relationship, SchemaGraph
from lacuna.functions.scalars import uniform
from lacuna.operators import relational as R
from lacuna.operators.tuple_factors import add_tf
from lacuna.sources.scratch import stored


def _first(df: DataFrame, key: str, order: Column, rate: float) -> DataFrame:
    """The keys of the int(rate * rows) rows that come first by (order, key); order is a number.

    Rows surely below the cut are taken by a comparison; only those around it, between two approximate quantiles that
    counts confirm, are sorted.
    """
    rows, near = stored(df.select(key, order.cast("double").alias("__o")), "removal-order"), 2e-4
    while True:
        at = [min(1.0, max(0.0, rate - near)), max(0.0, min(1.0, rate + near))]
        total, found = rows.agg(F.count("*"), F.percentile_approx("__o", F.array(*map(F.lit, at)), F.lit(20_000))).first()
        n = int(rate * total)
        if n <= 0 or n >= total:
            return rows.filter(F.lit(n > 0)).select(key)
        low, high = found
        low, high = F.lit(float("-inf") if at[0] == 0 else low), F.lit(float("inf") if at[1] == 1 else high)
        below, up_to = rows.agg(F.count_if(F.col("__o") < low), F.count_if(F.col("__o") <= high)).first()
        if below <= n <= up_to:
            break
        near *= 8
    around = rows.filter((F.col("__o") >= low) & (F.col("__o") <= high)).orderBy("__o", key).limit(n - below)
    return rows.filter(F.col("__o") < low).select(key).unionByName(around.select(key))


def uniform_keys(df: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    return _first(df, key, uniform(seed, "keep", F.col(key)), rate)


def bias_weights(df: DataFrame, key: str, attribute: str, rho: float, seed: int = 0) -> DataFrame:
    """key and v: weights whose correlation with the min-max normalised attribute is rho; rows without the attribute are left out.

    Two passes: the moments of attribute and draw give the regression and the spread of what it leaves; then the least
    weight and the sum.
    """
    y = df.filter(F.col(attribute).isNotNull()).select(key, F.col(attribute).cast("double").alias("a"), uniform(seed, "x", F.col(key)).alias("x"))
    facts = [F.min("a").alias("lo"), F.max("a").alias("hi"), F.regr_slope("x", "a").alias("b"), F.regr_intercept("x", "a").alias("c"), F.stddev_pop("a").alias("sa"), F.var_pop("x").alias("vx")]
    y = y.crossJoin(F.broadcast(y.agg(*facts)))
    part = lambda c: F.coalesce(F.try_divide(c, F.col("hi") - F.col("lo")), F.lit(0.0))
    rest = F.col("x") - F.coalesce(F.col("c") + F.col("b") * F.col("a"), F.lit(0.5))
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("vx") - F.coalesce(F.pow(F.col("b") * F.col("sa"), 2), F.lit(0.0))))
    weight = F.lit(rho) * left * part(F.col("a") - F.col("lo")) + part(F.col("sa")) * F.lit((1 - rho * rho) ** 0.5) * rest
    v = y.select(key, weight.alias("v"))
    low = v.agg(F.least(F.min("v"), F.lit(0.0)).alias("m"), F.sum("v").alias("s"), F.count("*").alias("n"))
    v = v.crossJoin(F.broadcast(low))
    return v.select(key, F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s") - F.col("m") * F.col("n")), F.lit(0.0)).alias("v"))


def bias_keys(df: DataFrame, key: str, attribute: str, rate: float, rho: float, seed: int = 0) -> DataFrame:
    """Kept keys: weighted without replacement (order of ln(u) / v); rows without the attribute uniformly at the same rate."""
    if rho < 0:
        gone = bias_keys(df, key, attribute, 1 - rate, -rho, seed)
        return R.not_in_keys(df.select(key), key, gone)
    v = bias_weights(df, key, attribute, rho, seed)
    order = F.when(F.col("v") > 0, -F.ln(uniform(seed, "keep", F.col(key))) / F.col("v")).otherwise(F.lit(float("inf")))
    some = _first(v, key, order, rate)
    none = df.filter(F.col(attribute).isNull())
    if none.isEmpty():
        return some
    return some.unionByName(uniform_keys(none, key, rate, seed))


def categorical_weights(df: DataFrame, key: str, attribute: str, values: list) -> DataFrame:
    """key and the share of its attribute's values that are in `values`; null where all are null."""
    share = F.try_divide(F.count_if(F.col(attribute).isin(*values)), F.count(attribute))
    return df.groupBy(key).agg(share.cast("double").alias("share"))


def categorical_keys(df: DataFrame, key: str, attribute: str, values: list, rate: float, rho: float, seed: int = 0) -> DataFrame:
    return bias_keys(categorical_weights(df, key, attribute, values), key, "share", rate, rho, seed)


def known_tf_keys(df: DataFrame, key: str, attribute: str | None, rate: float, seed: int = 0) -> DataFrame:
    """Parents whose tuple factor stays known; those without the removal attribute lose it first."""
    later = F.col(attribute).isNull().cast("double") if attribute else F.lit(0.0)  # a draw is below 1
    return _first(df, key, later + uniform(seed, "tf", F.col(key)), rate)


def remove(graph: SchemaGraph, frames: dict[str, DataFrame], table: str, kept: DataFrame, cascade: bool = True) -> dict[str, DataFrame]:
    """All tables after a table's rows outside `kept` go: their children go too, or lose the link. Frames are not changed."""
    out = dict(frames)
    key = graph.tables[table].key
    removed = R.not_in_keys(frames[table].select(key), key, kept)
    out[table] = R.in_keys(frames[table], key, kept)
    todo = [(r, removed) for r in graph.relationships if r.parent == table]
    while todo:
        r, gone = todo.pop(0)
        if not cascade:
            out[r.child] = R.cut_links(out[r.child], r, gone)
            continue
        child_key = graph.tables[r.child].key
        lost = R.in_keys(out[r.child], r.fk, gone).select(child_key)
        out[r.child] = R.not_in_keys(out[r.child], r.fk, gone)
        todo += [(c, lost) for c in graph.relationships if c.parent == r.child]
    return out


@dataclass(frozen=True)
class Removal:
    """What is to go from a table: kind is uniform, bias or categorical; rate is the share that stays."""

    table: str
    kind: str = "uniform"
    rate: float = 0.5
    attribute: str | None = None
    rho: float = 0.0
    values: tuple = ()
    cascade: bool = True
    known_tfs: float = 1.0
    sentinel: object = None

    def kept(self, df: DataFrame, key: str, seed: int) -> DataFrame:
        if self.sentinel is not None and self.attribute:
            df = R.sentinel_to_null(df, {self.attribute: self.sentinel})
        if self.kind == "uniform":
            return uniform_keys(df, key, self.rate, seed)
        if not self.attribute:
            raise ValueError(f"a removal by {self.kind} needs an attribute")
        if self.kind == "bias":
            return bias_keys(df, key, self.attribute, self.rate, self.rho, seed)
        if self.kind == "categorical":
            return categorical_keys(df, key, self.attribute, list(self.values), self.rate, self.rho, seed)
        raise ValueError(f"no such removal: {self.kind}")


def incomplete(graph: SchemaGraph, frames: dict[str, DataFrame], removals: list[Removal], tables: list[str] | None = None, seed: int = 0) -> tuple[SchemaGraph, dict[str, DataFrame]]:
    """A scenario in one call: removals one after the other over the given tables (all, if none are named), with tuple
    factors counted before, of which `known_tfs` of the parents keep theirs; and the graph with its tables that lost no
    row as complete ones."""
    own = {t: frames[t] for t in (tables or frames)}
    inner = SchemaGraph({t: graph.tables[t] for t in own}, tuple(r for r in graph.relationships if {r.child, r.parent} <= set(own)))
    before = {t: df.count() for t, df in own.items()}
    for r in inner.relationships:
        if r.tf not in own[r.parent].columns:
            own[r.parent] = add_tf(own[r.parent], own[r.child].select(r.fk), r)
    for i, x in enumerate(removals):
        key = inner.tables[x.table].key
        own = remove(inner, own, x.table, x.kept(own[x.table], key, seed + i), x.cascade)
        if x.known_tfs < 1:
            for r in inner.relationships:
                if r.child == x.table:
                    own[r.parent] = R.unknown_tf(own[r.parent], r, known_tf_keys(own[r.parent], r.pk, None, x.known_tfs, seed + i))
        own = {t: stored(df, f"remaining-{t}") for t, df in own.items()}
    return inner.with_complete(*(t for t, n in before.items() if own[t].count() == n)), own


def links_of(graph: SchemaGraph, table: str) -> list[Relationship]:
    return graph.touching(table)
