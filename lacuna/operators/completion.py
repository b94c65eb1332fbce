"""Completion joins: existing rows, and synthesized ones for those that are missing."""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lacuna.catalog import Path, Relationship
from lacuna.functions.scalars import uniform
from lacuna.operators import relational as R
from lacuna.operators.models import CountModel, sample_columns
from lacuna.operators.tuple_factors import CURRENT, add_current_tf
from lacuna.sources.scratch import stored

SYNTHETIC = "__synthetic"


def folded(c: Column) -> Column:
    """A whole number as one that isn't negative: 0, -1, 1, -2, 2 ... are 0, 1, 2, 3, 4 ..."""
    return F.when(c > 0, 2 * (c - 1) + 1).otherwise(-2 * c)


#: Bits of a key that tell apart rows of one hash.
TIE_BITS = 8


def synthetic_keys(df: DataFrame, name: str, of: str, nth: str | None = None, bounds: tuple | None = None) -> DataFrame:
    """df (stored) with a negative key, unique for each (of, nth): the pairing -(folded(of) * most + nth) - 1 where that
    stays within 63 bits for all rows, else a hash of 54 bits and the row's rank among those of its hash. Null `of` is
    not allowed. The same rows have the same keys, however they are partitioned. bounds: the least and largest `of`,
    and the largest nth, where they are known."""
    key = F.col(of).cast("long")
    second = F.col(nth).cast("long") if nth else F.lit(0).cast("long")
    low, high, most = bounds or df.agg(F.min(key), F.max(key), F.max(second)).first()
    most = int(most or 0) + 1
    if max(2 * int(high or 0), -2 * int(low or 0)) + 2 <= (1 << 62) // most:
        return df.withColumn(name, -(folded(key) * F.lit(most) + second) - 1)
    code = F.shiftrightunsigned(F.xxhash64(key, second), TIE_BITS + 2)
    rank = F.row_number().over(W.partitionBy("__code").orderBy(key, second)) - 1
    rank = F.when(rank < (1 << TIE_BITS), rank.cast("long")).otherwise(F.raise_error(F.lit("more rows of one hash than keys")))
    return df.withColumn("__code", code).withColumn(name, -(F.shiftleft("__code", TIE_BITS) + rank) - 1).drop("__code")


def _missing_and_bounds(parents: DataFrame, children: DataFrame, r: Relationship, train: DataFrame, evidence: list[str], seed: int = 0, support: int = 20, normalize: bool = True) -> tuple[DataFrame, tuple]:
    """missing_children(), and the least and largest key and the largest __missing of those that lack children."""
    p = stored(add_current_tf(parents, children, r), "complete-current")
    if p.filter(F.col(r.tf).isNull()).isEmpty():
        p = p.withColumn("__expected", F.col(r.tf))
    else:
        known = train.filter(F.col(r.tf) >= 0)
        inverse = F.when(F.col("__value") >= 1, 1 / F.col("__value")).otherwise(1.0)
        p = CountModel.fit(known, r.tf, evidence, support, weight=inverse).sample(p, uniform(seed, r.tf, F.col(r.pk)), "__drawn")
        p = stored(p.withColumn("__expected", F.coalesce(F.col(r.tf), F.col("__drawn"), F.lit(0))).drop("__drawn"), "complete-expected")
    p = p.withColumn("__short", F.greatest(F.lit(0), F.col("__expected") - F.col(CURRENT)).cast("double"))
    key = F.when(F.col("__short") > 0, F.col(r.pk))
    *means, most, low, high = p.agg(F.avg("__expected"), F.avg(CURRENT), F.avg("__short"), F.max("__short"), F.min(key), F.max(key)).first()
    e, c, m = (float(x or 0) for x in means)
    scale = (e - c) / m if normalize and m > 0 and e > c else 1.0
    p = p.withColumn("__missing", F.floor(F.col("__short") * F.lit(scale) + 1e-9).cast("int")).drop("__short")
    return p, (low, high, math.floor(float(most or 0) * scale + 1e-9))


def missing_children(parents: DataFrame, children: DataFrame, r: Relationship, train: DataFrame, evidence: list[str], seed: int = 0, support: int = 20, normalize: bool = True) -> DataFrame:
    """parents (stored) with __current_tf, __expected (known tuple factor, else a draw weighed by 1 / tf, by 1 below 1) and __missing."""
    return _missing_and_bounds(parents, children, r, train, evidence, seed, support, normalize)[0]


def join_1n(parents: DataFrame, children: DataFrame, r: Relationship, train_parents: DataFrame, child_key: str, columns: list[str], evidence: list[str], seed: int = 0, support: int = 20) -> DataFrame:
    """Parent to children: the existing children of the parents, and for each parent as many synthesized ones as it lacks.

    Synthesized rows have a negative child key, unique by (parent, nth child); other foreign keys stay null. Models
    learn from train_parents and their children: the existing rows, where these are the parents themselves.
    """
    same, parents = train_parents is parents, R.weighted(parents)
    existing = stored(R.join(parents, children, r), "complete-existing")
    p, bounds = _missing_and_bounds(parents, existing.select(r.fk), r, parents if same else train_parents, evidence, seed, support)
    lack = p.filter("__missing >= 1").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__missing"))))
    lack = lack.withColumn("__draw", F.concat_ws("#", F.col(r.pk).cast("string"), F.col("__nth").cast("string")))
    lack = synthetic_keys(lack, child_key, r.pk, "__nth", bounds)
    made = sample_columns(lack, existing if same else R.join(train_parents, children, r), columns, evidence, "__draw", seed, support)
    made = made.withColumn(r.fk, F.col(r.pk)).drop("__missing", "__expected", "__nth", "__draw", CURRENT).withColumn(SYNTHETIC, F.lit(True))
    return R.concat(existing.withColumn(SYNTHETIC, F.lit(False)), made)


def join_n1(children: DataFrame, parents: DataFrame, r: Relationship, child_key: str, columns: list[str], evidence: list[str], seed: int = 0, support: int = 20) -> DataFrame:
    """Child to parent: children with their parent, and a synthesized parent (negative key, tuple factor >= 1) for those without a link."""
    children = R.weighted(children)
    existing = stored(R.join(children, parents, r), "complete-existing")
    made = sample_columns(children.filter(F.col(r.fk).isNull()), existing, columns, evidence, child_key, seed, support)
    if r.tf in parents.columns and r.tf not in columns:
        positive = existing.filter(F.col(r.tf) >= 1)
        made = CountModel.fit(positive, r.tf, evidence, support).sample(made, uniform(seed, r.tf, F.col(child_key)))
    made = synthetic_keys(stored(made, "complete-made"), r.pk, child_key).withColumn(SYNTHETIC, F.lit(True))
    return R.concat(existing.withColumn(SYNTHETIC, F.lit(False)), made)


def project_requested(df: DataFrame, path: Path, columns: list[str]) -> DataFrame:
    """Weights over the product of the fan-out tuple factors, then the requested columns."""
    df = R.weighted(df)
    for r in path.fan_out():
        df = df.withColumn(R.WEIGHT, F.col(R.WEIGHT) / F.nullif(F.col(r.tf), F.lit(0)))
    return R.project(df, columns)


def check_completed(df: DataFrame, key: str, tfs: list[str]) -> dict:
    """Counts of broken promises: null keys, used tuple factors below 1, weights that are not finite."""
    bad = [F.count_if(F.col(key).isNull()).alias("null_keys"), F.count_if(~(F.abs(F.col(R.WEIGHT)) < float("inf"))).alias("bad_weights")]
    bad += [F.count_if(F.coalesce(F.col(t), F.lit(0)) < 1).alias(f"low_{t}") for t in tfs]
    return df.agg(*bad).first().asDict()


# ---------------------------------------------------------------- replacement of synthetic rows by existing ones


def greedy(targets: np.ndarray, candidates: np.ndarray, window: int) -> np.ndarray:
    """For each target in turn the nearest candidate that is still free, first in its window of candidates, then in all; -1: none is left."""
    out = np.full(len(targets), -1)
    free = np.ones(len(candidates), bool)
    parts = max(1, -(-len(targets) // max(1, window)))
    cuts = np.linspace(0, len(candidates), parts + 1).astype(int)
    left = len(candidates)
    for part in range(parts):
        lo, hi = cuts[part], cuts[part + 1]
        rows = range(part * window, min(len(targets), (part + 1) * window))
        square = ((targets[rows.start : rows.stop, None, :] - candidates[None, lo:hi, :]) ** 2).sum(2)
        for i in rows:
            if not left:
                return out
            near = np.where(free[lo:hi], square[i - rows.start], np.inf)
            if len(near) and np.isfinite(near.min()):
                best = lo + int(near.argmin())
            else:
                best = int(np.where(free, ((candidates - targets[i]) ** 2).sum(1), np.inf).argmin())
            out[i], free[best] = best, False
            left -= 1
    return out


def nearest_free(targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each target in turn the nearest of all candidates that are still free, ties to the first; -1: none is left."""
    out = np.full(len(targets), -1)
    if candidates.shape[1] == 1 and np.isfinite(candidates).all() and np.isfinite(targets).all():
        return _nearest_free_number(targets[:, 0], candidates[:, 0], out)
    free = np.arange(len(candidates))
    for i, t in enumerate(targets):
        if not len(free):
            break
        square = ((candidates[free] - t) ** 2).sum(1)
        known = np.flatnonzero(~np.isnan(square))  # what isn't a number comes last
        at = known[square[known].argmin()] if len(known) else 0
        out[i], free = free[at], np.delete(free, at)
    return out


def _nearest_free_number(targets: np.ndarray, candidates: np.ndarray, out: np.ndarray) -> np.ndarray:
    """nearest_free() of one number: its distinct values in order, each with its candidates; used up ones are skipped by links."""
    order = np.argsort(candidates, kind="stable")
    values, head, n = np.unique(candidates[order], return_index=True, return_counts=True)
    order, head, end = order.tolist(), head.tolist(), (head + n).tolist()
    place, values = np.searchsorted(values, targets).tolist(), values.tolist()
    # Places are shifted by one: 0 and the last are walls.
    links = {-1: list(range(len(values) + 2)), 1: list(range(len(values) + 2))}

    def find(j: int, step: int) -> int:
        link, way = links[step], []
        while link[j] != j:
            way.append(j)
            j = link[j]
        for x in way:
            link[x] = j
        return j

    for i, t in enumerate(targets.tolist()[: len(candidates)]):
        best, where = math.inf, None
        for step, j in ((-1, find(place[i], -1)), (1, find(place[i] + 1, 1))):
            while 0 < j <= len(values):
                gap = values[j - 1] - t
                if gap * gap > best:
                    break
                this = (gap * gap, order[head[j - 1]], j)
                where = this if where is None else min(where, this)
                best, j = where[0], find(j + step, step)
        out[i], j = where[1:]
        head[j - 1] += 1
        if head[j - 1] == end[j - 1]:
            links[-1][j], links[1][j] = j - 1, j + 1
    return out


def _standardised(existing: DataFrame, key: str, features: list[str], *more: Column | str):
    """A function from a frame to its key, more columns and features, standardised as in existing; mean where null."""
    facts = existing.agg(*[x for f in features for x in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))])

    def ready(df: DataFrame) -> DataFrame:
        df = df.crossJoin(F.broadcast(facts))
        cols = [F.coalesce(F.try_divide(F.coalesce(F.col(f).cast("double"), F.col(f"{f}__m")) - F.col(f"{f}__m"), F.col(f"{f}__s")), F.lit(0.0)).alias(f) for f in features]
        return df.select(F.col(key).cast("long").alias(key), *more, *cols)

    return ready


def replace_nearest(synthetic: DataFrame, existing: DataFrame, key: str, features: list[str], block: list[str], buckets: int = 1, window: int | None = None) -> DataFrame:
    """(existing key, synthetic key) pairs, one to one within each block: standardised features, mean where null. In the
    order of their keys, existing rows take the nearest synthetic one that is free, ties to the smaller key.

    block: columns that both share, by which rows meet (null meets nothing); `buckets` splits large blocks further by a
    hash of the key, `window` as greedy() does.
    """
    ready = _standardised(existing, key, features, *block, F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__b"))

    def assign(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        e, s = e.sort_values(key), s.sort_values(key)
        t, c = e[features].to_numpy(float), s[features].to_numpy(float)
        hit = greedy(t, c, window) if window else nearest_free(t, c)
        ok = hit >= 0
        return pd.DataFrame({"existing": e[key].to_numpy()[ok], "synthetic": s[key].to_numpy()[hit[ok]]})

    keys = [*block, "__b"]
    existing, synthetic = (ready(df.dropna(subset=block) if block else df).groupBy(*keys) for df in (existing, synthetic))
    return existing.cogroup(synthetic).applyInPandas(assign, "existing long, synthetic long")


#: Rows of both sides that meet in one cell.
CELL = 8_192


def curve(features: list[str]) -> Column:
    """A place that is near for near rows: one feature itself, several (standardised) along a Z-order curve."""
    if len(features) == 1:
        return F.col(features[0])
    n = min(len(features), 62)
    bits = min(16, 62 // n)
    steps = [F.floor(F.least(F.lit(2.0**bits - 1), F.greatest(F.lit(0.0), (F.col(f) + 4) * (2.0**bits / 8)))).cast("long") for f in features[:n]]
    return reduce(operator.add, (F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1).cast("long")), b * n + j) for j, q in enumerate(steps) for b in range(bits)))


def replace_in_cells(synthetic: DataFrame, existing: DataFrame, key: str, features: list[str], cell: int | None = None) -> DataFrame:
    """(existing key, synthetic key) pairs, one to one, as many as the smaller side has rows; for sides of any size.

    Rows of both sides are numbered along the features and cut into cells of so many rows; within a cell the rule of
    replace_nearest() holds. The rest, of which a cell had too many of one side, is numbered again, each side for
    itself; the smaller side is spread over the cells of the larger, so each row of it finds a partner.
    """
    cell = cell or CELL
    ready = _standardised(existing, key, features, F.lit(None).cast("boolean").alias("__made"))
    both = ready(existing).withColumn("__made", F.lit(False)).unionByName(ready(synthetic).withColumn("__made", F.lit(True)))
    both = R.numbered(both.withColumn("__z", curve(features)), ["__z", F.xxhash64(key, "__made"), key, "__made"], "__at")

    def assign(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(key)
        e, s = x[~x["__made"]], x[x["__made"]]
        hit = nearest_free(e[features].to_numpy(float), s[features].to_numpy(float))
        ok = hit >= 0
        x["__with"] = pd.Series(s[key].to_numpy()[hit[ok]], index=e.index[ok], dtype="Int64").reindex(x.index)
        met = np.zeros(len(s), bool)
        met[hit[ok]] = True
        return x.drop(index=s.index[met])[[key, "__made", "__z", *features, "__with"]]

    made = [F.col(key).alias("existing"), F.col("__with").alias("synthetic")]
    kinds = f"{key} long, __made boolean, __z {dict(both.dtypes)['__z']}, {', '.join(f'`{f}` double' for f in features)}, __with long"
    in_cells = lambda df: df.groupBy(F.expr(f"__at div {cell}").alias("__cell")).applyInPandas(lambda x: assign(x), kinds)
    first = stored(in_cells(both), "replace-cells")
    out, rest = first.filter(F.col("__with").isNotNull()).select(*made), first.filter(F.col("__with").isNull()).drop("__with")
    sides = {r["__made"]: r["count"] for r in rest.groupBy("__made").count().collect()}
    if len(sides) < 2:
        return out
    small, large = sorted(sides, key=sides.get)
    a, b = (R.numbered(rest.filter(F.col("__made") == side), ["__z", key], "__at") for side in (small, large))
    a = a.withColumn("__at", F.expr(f"__at * {sides[large]} div {sides[small]}"))
    return out.unionByName(in_cells(a.unionByName(b)).filter(F.col("__with").isNotNull()).select(*made))


def replace_lsh(synthetic: DataFrame, existing: DataFrame, key: str, vector: str, k: int = 20, length: float = 2.0, tables: int = 3, radius: float = 10.0) -> DataFrame:
    """(existing key, synthetic key, distance): up to k near synthetic rows of each existing one, by random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    lsh = BucketedRandomProjectionLSH(inputCol=vector, outputCol="__h", bucketLength=length, numHashTables=tables, seed=1).fit(existing)
    met = lsh.approxSimilarityJoin(existing, synthetic, radius, "d")
    met = met.select(F.col(f"datasetA.{key}").alias("existing"), F.col(f"datasetB.{key}").alias("synthetic"), "d")
    w = W.partitionBy("existing").orderBy("d", "synthetic")
    return met.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def one_to_one(near: DataFrame, rounds: int = 50) -> DataFrame:
    """(existing, synthetic, d) of near(existing, synthetic, d), each at most once: in each round the pairs of which each
    is the other's nearest, ties to the smaller key; the rest goes on. Ends when no pair is left, `rounds` at the latest."""
    near, out = stored(near.select("existing", "synthetic", "d"), "near"), None
    for k in range(rounds):
        first = lambda by, other: F.row_number().over(W.partitionBy(by).orderBy("d", other))
        both = near.withColumn("__e", first("existing", "synthetic")).withColumn("__s", first("synthetic", "existing"))
        won = stored(both.filter("__e = 1 and __s = 1").select("existing", "synthetic", "d"), f"near-won{k}")
        out = won if out is None else out.unionByName(won)
        near = stored(near.join(won.select("existing"), "existing", "left_anti").join(won.select("synthetic"), "synthetic", "left_anti"), f"near-left{k}")
        if near.isEmpty():
            break
    return out


#: Pairs of existing and synthesized rows beyond which they meet in cells.
EXACT_PAIRS = 4_000_000


def replace_parents(df: DataFrame, parents: DataFrame, r: Relationship, child_key: str, features: list[str], buckets: int | None = None, approximate: bool = False) -> DataFrame:
    """A completed n:1 join in which existing parents take the place of synthesized ones, one to one.

    An existing parent can be taken as often as it lacks children (its tuple factor, less the children that it has in
    df). The nearest by the features (numbers) wins, by the exact greedy rule, beyond EXACT_PAIRS in cells of near rows;
    as many are replaced as there are places or synthesized parents. buckets: the rule within buckets of a hash;
    approximate: by random projections; both may leave some that could be replaced. Where a parent's tuple factor is
    null, the synthesized one stays. Synthesized parents that find none stay as they are.
    """
    df = stored(df, "replace-joined")
    have = df.filter(F.col(r.pk) >= 0).groupBy(F.col(r.pk).alias("__k")).agg(F.count("*").alias("__have"))
    lack = parents.join(have, F.col(r.pk) == F.col("__k"), "left").withColumn("__lack", F.col(r.tf) - F.coalesce("__have", F.lit(0)))
    lack = lack.filter("__lack > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__lack").cast("long"))))
    slots = stored(lack.select(r.pk, "__nth", *features), "replace-slots")
    slots = synthetic_keys(slots, "__slot", r.pk, "__nth").withColumn("__slot", -F.col("__slot"))
    made = df.filter(F.col(r.pk) < 0).select(F.col(child_key).alias("__slot"), *features)
    n, m = slots.count(), made.count()
    if not n or not m:
        return df
    if approximate:
        from pyspark.ml.feature import VectorAssembler

        ready = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
        pairs = one_to_one(replace_lsh(ready.transform(made), ready.transform(slots), "__slot", "__x")).drop("d")
    elif buckets or n * m <= EXACT_PAIRS:
        pairs = replace_nearest(made, slots, "__slot", features, [], buckets or 1)
    else:
        pairs = replace_in_cells(made, slots, "__slot", features)
    pairs = stored(pairs, "replace-pairs").join(slots.select(F.col("__slot").alias("existing"), F.col(r.pk).alias("__pk")), "existing").select(F.col("synthetic").alias("__c"), "__pk")
    new = parents.drop(R.WEIGHT)
    new = new.select(F.col(r.pk).alias("__new"), *[F.col(c).alias(f"__new_{c}") for c in new.columns if c != r.pk])
    out = df.join(pairs, F.col(child_key) == F.col("__c"), "left").join(new, F.col("__pk") == F.col("__new"), "left")
    taken = F.col("__pk").isNotNull()
    for c in parents.drop(R.WEIGHT).columns:
        # A tuple factor that the new parent doesn't know stays that of the synthesized one.
        other = F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c.startswith("tf_") else F.col("__pk") if c == r.pk else F.col(f"__new_{c}")
        out = out.withColumn(c, F.when(taken, other).otherwise(F.col(c)))
    out = out.withColumn(r.fk, F.when(taken, F.col("__pk")).otherwise(F.col(r.fk)))
    return out.select(*df.columns)


def expected_appearance(df: DataFrame, features: list[str], label: str, current: str, name: str = "expected") -> DataFrame:
    """df with the label where it is known, else the regression's prediction, not below the current appearance."""
    model = appearance_model(df.filter(F.col(label).isNotNull()), features, label)
    out = model.transform(df)
    return out.withColumn(name, F.coalesce(F.col(label).cast("double"), F.greatest(F.col("prediction"), F.col(current).cast("double")))).drop("__x", "prediction")


def appearance_model(df: DataFrame, features: list[str], label: str):
    """Regression of the expected appearance where it isn't known."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), GBTRegressor(featuresCol="__x", labelCol=label, maxIter=10, seed=1)]).fit(df)
