"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Vectors are dealt into bands of about equal norm and, within a band, into shards by a hash of their id. Each shard
builds one graph: points enter in growing batches; a greedy beam search from the entry point proposes neighbours;
relaxed-distance pruning keeps a neighbour only if no kept one is nearer to it by the factor `alpha`; reverse edges are
pruned in the same way. For inner products, a further coordinate gives all of a shard's vectors one norm, so that
nearest in distance is largest in product; bands of like norms keep that coordinate small. Each shard measures its
own recall against brute force, with some of its points as queries, and doubles its beam until `goal` is reached.

A query goes to every shard, in blocks of queries; beam search finds the shard's best, whose products are computed
again in double precision from the original vectors. A task takes a few shards and hands on each query's best of them
together; the best over all tasks are kept.

Equal vectors are one point of the graph; its members are the ids that have it, of which a query needs no more than
the k + 1 smallest. So no common vector makes a hot shard or a crowded neighbourhood.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite components, and rows without an
id, take no part, neither as query nor as candidate; of rows with one id the smallest vector counts; vectors meet
only vectors of their length; with fewer than k other vectors all are returned; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_side, stored

K = 20
QUERIES_BY = 20
SHARD = 2048
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Ratio of the norms in a band; recall that a shard asks of its beam, and how many of its points measure it.
STEP, GOAL, PROBES = 1.1, 0.97, 64
BATCH = 512
#: Queries, and shards, that meet in one task; of its shards' findings the task hands on the best.
BLOCK, SHARDS_A_TASK = 8192, 4


class Graph:
    """A robust-pruned graph over the rows of x (float32), nearest by squared distance."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = x, edges, entry
        self.norm = (x * x).sum(1)

    @staticmethod
    def augmented(x: np.ndarray) -> np.ndarray:
        x = x / max(float(np.abs(x).max(initial=0)), 5e-324)  # no norm is beyond what 32 bits hold
        square = (x.astype(np.float64) ** 2).sum(1)
        return np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
        n = len(x)
        entry = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if n else 0
        g = cls(x, np.full((n, degree), -1, np.int32), entry)
        order = np.random.Generator(np.random.PCG64(n)).permutation(n)
        order = np.concatenate([[entry], order[order != entry]]) if n else order
        at = 1
        while at < n:
            step = order[at : at + min(BATCH, max(1, at // 4))]
            near, dist = g.search(x[step], beam)
            g._link(step, near, dist, alpha)
            at += len(step)
        return g

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared, of each query to its row of ids."""
        dot = np.matmul(self.x[ids], q[:, :, None])[:, :, 0]
        return np.maximum((q * q).sum(1)[:, None] + self.norm[ids] - 2 * dot, 0)

    def search(self, q: np.ndarray, beam: int = BEAM, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """The beam's ids (-1: none) and squared distances, nearest first."""
        m, n = len(q), len(self.x)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        if not n:
            return ids, dist
        ids[:, 0] = self.entry
        dist[:, 0] = self.distances(q, ids[:, :1])[:, 0]
        seen[:, self.entry] = True
        live = np.arange(m)
        while len(live):
            todo = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
            pick = np.argsort(todo, axis=1)[:, :wide]
            rows = np.arange(len(live))[:, None]
            open_ = np.isfinite(todo[rows, pick])
            has = open_.any(1)
            live, pick, open_ = live[has], pick[has], open_[has]
            if not len(live):
                break
            cur = np.where(open_, ids[live[:, None], pick], -1)
            done[live[:, None], pick] |= open_
            near = np.where((cur >= 0)[:, :, None], self.edges[np.maximum(cur, 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            rows = np.broadcast_to(live[:, None], near.shape)
            seen[rows[fresh], near[fresh]] = True
            d = np.where(fresh, self.distances(q[live], np.maximum(near, 0)), np.inf)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_d = np.concatenate([dist[live], d.astype(np.float32)], axis=1)
            all_done = np.concatenate([done[live], np.zeros_like(fresh)], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            rows = np.arange(len(live))[:, None]
            ids[live], dist[live], done[live] = all_ids[rows, best], all_d[rows, best], all_done[rows, best]
        return ids, dist

    def _pruned(self, cand: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each row of candidates (-1: none), nearest first in the result."""
        degree = self.edges.shape[1]
        by = np.argsort(np.where(cand < 0, np.inf, dist), axis=1, kind="stable")
        rows = np.arange(len(cand))[:, None]
        cand, dist = cand[rows, by], dist[rows, by]
        v = self.x[np.maximum(cand, 0)]
        square = self.norm[np.maximum(cand, 0)]
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive, out = cand >= 0, np.full((len(cand), degree), -1, np.int32)
        every = np.arange(len(cand))
        for k in range(degree):
            has = alive.any(1)
            if not has.any():
                break
            first = alive.argmax(1)
            out[has, k] = cand[has, first[has]]
            alive &= ~(alpha * alpha * between[every, first] <= dist)
            alive[every, first] = False
        return out

    def _link(self, points: np.ndarray, near: np.ndarray, dist: np.ndarray, alpha: float) -> None:
        self.edges[points] = kept = self._pruned(near, dist, alpha)
        source, target = np.repeat(points, kept.shape[1]), kept.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        # A node's new reverse edges, so many at a time as fit beside those that it has.
        wide = self.edges.shape[1]
        while len(target):
            nodes, begin, many = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(begin, many)
            now = place < wide
            more = np.full((len(nodes), wide), -1, np.int32)
            more[np.repeat(np.arange(len(nodes)), many)[now], place[now]] = source[now]
            cand = np.concatenate([self.edges[nodes], more], axis=1)
            room = (cand >= 0).sum(1) <= wide
            packed = np.sort(np.where(cand < 0, np.iinfo(np.int32).max, cand), axis=1)[:, :wide]
            self.edges[nodes[room]] = np.where(packed == np.iinfo(np.int32).max, -1, packed)[room]
            full = nodes[~room]
            for i in range(0, len(full), 256):
                part, c = full[i : i + 256], cand[~room][i : i + 256]
                d = np.where(c < 0, np.inf, self.distances(self.x[part], np.maximum(c, 0)))
                self.edges[part] = self._pruned(c, d.astype(np.float32), alpha)
            source, target = source[~now], target[~now]


def fitting_beam(g: Graph, x: np.ndarray, k: int, goal: float, least: int = BEAM, probes: int = PROBES) -> int:
    """The narrowest beam, of least doubled again and again, whose mean recall of the k best is at least goal for points of the shard."""
    n = len(x)
    if n <= least:
        return least
    rows = np.random.Generator(np.random.PCG64(n + 1)).choice(n, min(n, probes), replace=False)
    q = x[rows]
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    beam = least
    while beam < n:
        near, _ = g.search(as_query(g, q), beam)
        hits = sum(len(np.intersect1d(a[:k], b)) for a, b in zip(near, best))
        if hits >= goal * best.size:
            break
        beam *= 2
    return min(beam, n)


def as_query(g: Graph, q: np.ndarray) -> np.ndarray:
    """Queries as points: with the shard's norm, and nothing in the further coordinate."""
    scale = np.sqrt((q * q).sum(1, keepdims=True))
    return np.concatenate([q / scale * np.sqrt(float(g.norm[0])), np.zeros((len(q), 1))], axis=1).astype(np.float32)


def _build(k: int, goal: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        g = Graph.build(Graph.augmented(x))
        return pd.DataFrame(
            {
                "width": [x.shape[1]],
                "shard": [rows["shard"].iloc[0]],
                "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
                "vectors": [x.tobytes()],
                "points": [g.x.tobytes()],
                "edges": [g.edges.tobytes()],
                "entry": [g.entry],
                "beam": [fitting_beam(g, x, k, goal)],
            }
        )

    return run


def _of_shard(s, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam's ids (beyond all ids: none) and their products with it (-inf)."""
    ids = np.frombuffer(s["ids"], np.int64)
    x = np.frombuffer(s["vectors"], np.float64).reshape(len(ids), -1)
    points = np.frombuffer(s["points"], np.float32).reshape(len(ids), -1)
    g = Graph(points, np.frombuffer(s["edges"], np.int32).reshape(len(ids), -1), int(s["entry"]))
    near, _ = g.search(as_query(g, asked), int(s["beam"]))
    score = np.where(near >= 0, np.einsum("qd,qkd->qk", asked, x[np.maximum(near, 0)]), -np.inf)
    return np.where(near >= 0, ids[np.maximum(near, 0)], np.iinfo(np.int64).max), score


def _search(k: int):
    def run(shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in range(0, len(asked) if len(shards) else 0, 256):
            part = asked.iloc[a : a + 256]
            q = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            found, score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for _, s in shards.iterrows():
                more, its = _of_shard(s, q)
                found, score = np.concatenate([found, more], axis=1), np.concatenate([score, its], axis=1)
                by = np.lexsort((found, -score), axis=1)[:, : k + 1]
                rows = np.arange(len(q))[:, None]
                found, score = found[rows, by], score[rows, by]
            ok = np.isfinite(score)
            out.append(pd.DataFrame({"query": np.repeat(part["vec_id"].to_numpy(np.int64), ok.sum(1)), "point": found[ok], "score": score[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "point": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles), one row an id, of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    v = v.filter("vec_id is not null and size(embedding) > 0").filter(F.forall("embedding", fine)).filter(F.exists("embedding", lambda c: c != 0))
    # -0.0 and 0.0 are one value.
    v = v.withColumn("embedding", F.transform("embedding", lambda c: c + F.lit(0.0)))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def dealt(points: DataFrame, shard: int, step: float = STEP) -> tuple[DataFrame, DataFrame]:
    """points with their shard, and for each width its number of shards. Norms in a band differ by a factor of `step` at most."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    points = points.withColumn("most", most).withColumn("band", F.floor((F.ln("most") + F.ln(square) / 2) / F.lit(float(np.log(step)))).cast("int")).drop("most")
    points = stored(points, "ann-banded")
    # The range of doubles bounds the number of bands.
    sizes = points.groupBy("width", "band").agg(F.ceil(F.count("*") / F.lit(shard)).cast("long").alias("own"))
    before = W.partitionBy("width").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("long")), "ann-sizes")
    points = points.join(small_side(sizes), ["width", "band"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("own"))).drop("band", "own", "first")
    return points, sizes.groupBy("width").agg(F.sum("own").cast("long").alias("shards"))


def search(vectors: DataFrame, is_query, k: int = K, shard: int = SHARD, block: int = BLOCK, goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id and score. is_query: a condition on vec_id."""
    rows = stored(usable(vectors), "ann-vectors")
    code = rows.select("vec_id", F.sha2(F.to_json("embedding"), 256).alias("code"))
    members = code.withColumn("nth", F.row_number().over(W.partitionBy("code").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    points = code.groupBy("code").agg(F.min("vec_id").alias("point"))
    members = stored(members.join(points, "code").select("point", "vec_id"), "ann-members")
    points = rows.join(points.select(F.col("point").alias("vec_id")), "vec_id", "left_semi").withColumn("width", F.size("embedding"))
    points, sizes = dealt(stored(points, "ann-points"), shard)
    # As many tasks as there are shards: their work is long, their rows are few.
    shards = int(sizes.agg(F.sum("shards")).first()[0] or 1)
    graphs = stored(
        points.select("width", "shard", "vec_id", "embedding").repartition(min(2 * shards, 20_000), "width", "shard").groupBy("width", "shard").applyInPandas(
            _build(k, goal), "width int, shard long, ids binary, vectors binary, points binary, edges binary, entry int, beam int"
        ),
        "ann-graphs",
    )
    asking = code.filter(is_query(F.col("vec_id"))).select("code", F.col("vec_id").alias("query_id"))
    first = code.groupBy("code").agg(F.min("vec_id").alias("query"))
    asking = stored(asking.join(first, "code").select("query", "query_id"), "ann-asking")
    asked = points.select("width", "vec_id", "embedding").join(asking.select(F.col("query").alias("vec_id")).distinct(), "vec_id", "left_semi")
    blocks = -(-max(1, asked.count()) // block)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).join(sizes, "width")
    parts = F.floor((F.col("shards") - 1) / SHARDS_A_TASK).cast("long")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts)))
    there = graphs.withColumn("part", F.floor(F.col("shard") / SHARDS_A_TASK).cast("long"))
    there = there.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["width", "part", "block"]
    tasks = min(2 * -(-shards // SHARDS_A_TASK) * blocks, 20_000)
    there, asked = there.repartition(tasks, *keys), asked.select(*keys, "vec_id", "embedding").repartition(tasks, *keys)
    met = there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(k), "query long, point long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "point")
    best = stored(met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), "ann-found")
    wide = best.join(members, "point").select("query", "vec_id", "score").join(asking, "query").filter("vec_id != query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return wide.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return search(embeddings, lambda v: v % QUERIES_BY == 0)
