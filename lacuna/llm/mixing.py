"""Mixing sources to target weights by the cube method.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; each gets its share of all words, but no more
than `limit` times its own words, and what is over is shared again by weight. That is a water level: target =
min(limit * words, level * weight), solved in one pass over the sources in the order of limit * words / weight.

With f = target / words of a source, each document is taken floor(f) times whole, and once more with inclusion
probability f - floor(f). The cube method decides which: a flight moves the probabilities of three documents at a
time along the null space of their two balancing equations (number of documents, number of words) until one of
them is 0 or 1, so that both totals stay as they are. A block of documents is one group's work; at most two
documents of a block stay undecided. These go on to a wider block, level by level, until one small block of each
source is left, where the last documents are rounded to come nearest to the totals (landing).

Every random draw is a hash of the document, so reruns agree and a lost task gives the same rows again. Documents
that are equal in doc_id, source and size are one unit with a multiplicity, so that no repeated row makes a hot block.

Defined results: a null text has size 0 and is taken 0 words; null doc_id and null source are values like others;
repeated rows are each returned; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lacuna.operators import relational

from .common import small_side, stored, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
#: Documents in a block, about; and blocks whose leftovers meet in one block of the next level.
BLOCK = 4096
FAN_IN = 1024
EDGE = 1e-9


def targets(per: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """per (source, source_size, n) with target. Sources are numbered and summed up in ranges: no task sees them all."""
    by_name = F.col("source").asc_nulls_last()
    per = relational.numbered(per, [by_name], "nth")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(limit))
    # The first sources in the order of most / weight are at their limit; the level follows from the rest.
    per = per.withColumn("order", F.col("most") / F.col("weight"))
    per = relational.running_totals(per, {"capped": "most", "light": "weight"}, ["order", by_name])
    whole = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("heavy"))
    level = (F.col("total") - F.col("capped") + F.col("most")) / (F.col("heavy") - F.col("light") + F.col("weight"))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("light", "level"))
    first = per.crossJoin(F.broadcast(whole)).withColumn("level", level).agg(F.min(holds).alias("first"))
    target = F.when(F.col("light") >= F.col("first.light"), F.col("first.level") * F.col("weight")).otherwise(F.col("most"))
    return per.crossJoin(F.broadcast(first)).select("source", "source_size", "n", target.cast("double").alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: p moved to 0 or 1, but for at most two, with sum(p) and sum(p * size) kept. draw: a uniform number for each."""
    p = p.astype(float)
    open_, out = [], p.copy()
    for i in range(len(p)):
        v = out[i]
        if v <= EDGE or v >= 1 - EDGE:
            out[i] = round(v)
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        sa, sb, sc = float(size[a]), float(size[b]), float(size[c])
        u = (sc - sb, sa - sc, sb - sa)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, x in zip(open_, u):
            if x > 0:
                up, down = min(up, (1 - out[k]) / x), min(down, out[k] / x)
            elif x < 0:
                up, down = min(up, out[k] / -x), min(down, (1 - out[k]) / -x)
        move = up if draw[i] * (up + down) < down else -down
        left = []
        for k, x in zip(open_, u):
            out[k] += move * x
            if out[k] <= EDGE or out[k] >= 1 - EDGE:
                out[k] = 0.0 if out[k] < 0.5 else 1.0
            else:
                left.append(k)
        open_ = left
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few fractional p rounded so that the words come nearest to their total, then the documents to theirs."""
    out = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return out
    words, docs = float((p[left] * size[left]).sum()), float(p[left].sum())
    best = min(
        range(1 << len(left)),
        key=lambda m: (
            round(abs(sum(size[k] for j, k in enumerate(left) if m >> j & 1) - words), 6),
            abs(bin(m).count("1") - docs),
            m,
        ),
    )
    for j, k in enumerate(left):
        out[k] = float(best >> j & 1)
    return out


def _level(last: bool, level: int):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "unit"], kind="stable", ignore_index=True)
        size = rows["size"].to_numpy(float)
        coins = np.array([(zlib.crc32(f"{u}{level}".encode()) + 0.5) / 2**32 for u in rows["unit"]])
        p = fly(rows["p"].to_numpy(float), size, coins)
        if last:
            p = land(p, size)
        return rows.assign(p=p)

    return one


def mix(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) for each row of docs(doc_id, text, source)."""
    sizes = docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"))
    units = stored(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("many")), "mix-units")
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count("*").alias("n"))
    goals = targets(per, weights, limit).withColumnRenamed("source", "own")
    goals = goals.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block))).cast("long"))
    goals = stored(goals, "mix-goals")

    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    units = units.join(small_side(goals), F.col("source").eqNullSafe(F.col("own"))).drop("own", "n")
    units = units.withColumn("whole", F.floor("f")).withColumn("part", F.col("f") - F.floor("f"))
    # Of `many` equal rows, floor(many * part) are taken once more for sure.
    units = units.withColumn("sure", F.floor(F.col("many") * F.col("part") + F.lit(EDGE)))
    units = units.withColumn("p", F.greatest(F.lit(0.0), F.col("many") * F.col("part") - F.col("sure")))
    units = units.withColumn("unit", F.sha2(F.concat_ws("|", key, F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string")), 256))
    units = units.withColumn("draw", F.conv(F.substring("unit", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)))
    units = units.withColumn("block", F.pmod(F.conv(F.substring("unit", 13, 12), 16, 10).cast("long"), F.col("blocks")))
    units = stored(units.drop("blocks", "f", "part"), "mix-probabilities")

    most = goals.agg(F.max("blocks")).first()[0] or 1
    moving = units.select("unit", "source", "block", "size", "p", "draw")
    decided, level = None, 0
    while True:
        last = most <= 1
        group = moving.groupBy("source", "block")
        flown = stored(group.applyInPandas(_level(last, level), ", ".join(f"`{c}` {t}" for c, t in moving.dtypes)), f"mix-level{level}")
        done = flown.filter((F.col("p") == 0) | (F.col("p") == 1)).select("unit", "p")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        moving = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("block", F.floor(F.col("block") / fan_in))
        moving = moving.withColumn("draw", F.conv(F.substring(F.sha2(F.concat("unit", F.lit(str(level))), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)))
        most, level = -(-most // fan_in), level + 1
    out = units.drop("p").join(decided.withColumnRenamed("p", "chosen"), "unit")
    out = out.withColumn("extra", F.col("sure") + F.col("chosen").cast("long"))
    # Each of the `many` equal rows again, in runs that never make a long array.
    run = 10_000
    out = out.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("many") - 1, F.lit(run))))
    out = out.withColumn("nth", F.explode(F.sequence(F.col("start"), F.least(F.col("many") - 1, F.col("start") + (run - 1)))))
    times = F.col("whole") + F.when(F.col("nth") < F.col("extra"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.cast("long").alias("times"), "source")


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return mix(documents).drop("times", "source")


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The documents, each as often as the mix takes it. Rows that are equal in doc_id, source and size share their number of times."""
    size = word_count(text_or_empty())
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars", size.alias("size"))
    took = mix(documents, **how).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count("*").alias("many"))
    took = took.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "times", "many")
    both = docs.join(took, docs["doc_id"].eqNullSafe(took["d"]) & docs["source"].eqNullSafe(took["s"]) & (docs["size"] == took["z"]))
    # Rows that share their times get the same number of them; what is over goes to the first in the order of a hash.
    # Copies are counted before they meet, so that a hot one is a row.
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    single = both.filter("many = 1").withColumn("same", one).withColumn("start", zero)
    several = both.filter("many > 1")
    several = several.groupBy(*several.drop("d", "s", "z").columns).agg(F.count("*").alias("same"))
    up_to = W.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text", "lang", "n_chars")).rowsBetween(W.unboundedPreceding, 0)
    both = single.drop("d", "s", "z").unionByName(several.withColumn("start", F.sum("same").over(up_to) - F.col("same")))
    over = F.greatest(zero, F.least("same", F.col("times") % F.col("many") - F.col("start")))
    both = both.withColumn("share", F.floor(F.col("times") / F.col("many")) * F.col("same") + over).filter("share > 0")
    # In runs that never make a long array.
    run = 10_000
    both = both.withColumn("from", F.explode(F.sequence(one, "share", F.lit(run).cast("long"))))
    times = F.explode(F.sequence("from", F.least("share", F.col("from") + (run - 1))))
    return both.select("doc_id", "text", "lang", "source", "n_chars", times.alias("x")).drop("x")
