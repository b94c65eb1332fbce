"""Near-duplicate join on the Jaccard similarity of word n-gram sets, by MinHash banding.

1. Copies of a text are one node (the MD5 of the text), with the smallest doc_id as its own.
2. Each node's MinHash signature is cut into bands; rows a band and bands are chosen for the target recall at the
   threshold. Nodes meet in the shuffle on band hashes.
3. Each member of a bucket is verified against the bucket's pivot, its smallest node, on the full n-gram sets. Links
   that hold make components. A bucket whose members are one component is done.
4. In the other buckets the distance 1 - J to the pivot, known by now, tells which members may be linked at all: it is
   a metric, so that linked members lie at most 1 - threshold apart in it. Members are dealt into rings of that width
   around the pivot; only those in one ring or in two neighbouring ones, of different components, remain to be
   compared. Buckets with few such members give pairs to be verified (at most a fixed number for each member). Larger
   ones are dealt into blocks of texts; two blocks (or one with itself) meet in a task, which computes the sizes of
   all intersections as a product of matrices and gives back a spanning forest of the links, no pairs.
5. A component is a class. Within a class every two texts are compared in blocks in the same way. Texts of sizes too
   far apart for the threshold never meet in a large class.

So of two texts that share a bucket, the link is verified itself, or both already lie in one class by verified links. `n_links` counts all other texts of the class at or above the threshold, not only those that buckets
led to; copies of one text count no link.

Defined results: a text of fewer than n words has one n-gram, all its words; a text without words, or null, has none
and is alone in its class, but for its exact copies; a null doc_id is kept, and a class's id is its smallest doc_id
that is not null; repeated rows are copies; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, steps, stored, text_or_empty, words_of, worker_cache

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions at most, for the choice of bands.
HASHES = 256
#: Members of different components that a bucket may have for its pairs to be rows; larger ones go by blocks.
FEW = 32
#: Pairs of one pivot that meet its text in one task, about.
PAIRS_OF_PIVOT = 2_000
#: Texts and n-grams that a block of a class has on average at most; a class within both bounds is one block.
BLOCK_TEXTS, BLOCK_GRAMS = 1_024, 1_000_000
#: n-grams of a block that one product of matrices takes.
COLUMNS_A_PRODUCT = 4_096


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the recall at the threshold allows with at most `most` hash functions."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngrams(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each text, text after text, and where each text begins."""
    words, offsets = words_of(texts)
    coded = words.dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist() + [None], object)[:-1]
    h = pd.util.hash_array(distinct, categorize=False).astype(np.uint64)[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)
    sizes = np.diff(offsets)
    out_sizes = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    starts = np.concatenate([[0], np.cumsum(out_sizes)])
    within = np.arange(starts[-1]) - np.repeat(starts[:-1], out_sizes)
    at, left = np.repeat(offsets[:-1], out_sizes) + within, np.repeat(sizes, out_sizes)
    value = np.full(len(at), np.uint64(0x243F6A8885A308D3))
    for k in range(n):
        has = left > k
        word = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else h
        value = np.where(has, (value ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1), value)
        value ^= value >> np.uint64(31)
    return mixed(value), starts


def _sign(n: int, bands: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(20_240_901))
    a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def run(batches):
        worker_cache("join")
        for batch in batches:
            for step in steps(batch):
                grams, starts = ngrams(step.column("text"), n)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes > 0)
                keys = np.zeros((len(full), bands), np.uint64)
                for band in range(bands if len(full) else 0):
                    key = np.full(len(full), np.uint64(band + 1))
                    for k in range(band * rows, (band + 1) * rows):
                        key = mixed(key ^ np.minimum.reduceat(mixed_fast(grams, a[k], b[k]), starts[full])) + np.uint64(k)
                    keys[:, band] = key
                ends = np.zeros(len(sizes) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                lists = lists if len(full) == len(sizes) else pa.array([x.as_py() or None for x in lists], pa.list_(pa.int64()))
                # The number of different n-grams.
                own = np.repeat(np.arange(len(sizes)), sizes)
                by = np.lexsort((grams, own))
                new = np.ones(len(by), bool)
                new[1:] = (grams[by][1:] != grams[by][:-1]) | (own[by][1:] != own[by][:-1])
                many = np.bincount(own[by][new], minlength=len(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([step.column("node"), step.column("doc_id"), pa.array(many), lists], names=["node", "doc_id", "size", "bands"])

    return run


def mixed_fast(grams: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    return grams * a + b


def _verify(n: int):
    def run(batches):
        for batch in batches:
            for step in _pairs(batch):
                left, right = step.column("a"), step.column("b")
                names = pa.concat_arrays([left, right]).dictionary_encode()
                code = np.asarray(names.indices)
                _, first = np.unique(code, return_index=True)
                texts = pa.concat_arrays([step.column("text_a"), step.column("text_b")]).take(pa.array(first))
                grams, starts = ngrams(texts, n)
                sets = [np.unique(grams[starts[i] : starts[i + 1]]) for i in range(len(first))]
                m, out = len(left), np.zeros(len(left))
                for i in range(m):
                    x, y = sets[code[i]], sets[code[m + i]]
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    out[i] = common / max(1, len(both) - common)
                yield pa.RecordBatch.from_arrays([left, right, pa.array(out)], names=["a", "b", "j"])

    return run


def _pairs(batch: pa.RecordBatch):
    for part in steps(batch, "text_a"):
        yield from steps(part, "text_b")


def verified(pairs: DataFrame, texts: DataFrame, n: int, name: str, pivots: DataFrame | None = None) -> DataFrame:
    """j for each pair (a, b) of nodes. pivots(b, parts): the text of b is there so many times, and pairs(a, b, parts) are dealt over them."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    keys = ["b"]
    if pivots is not None:
        keys = ["b", "part"]
        two = two.join(pivots, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    met = pairs.join(one, "a").join(two, keys).select("a", "b", "text_a", "text_b")
    return stored(bounded_batches(met).mapInArrow(_verify(n), "a binary, b binary, j double"), name)


#: Edges that a task of the component search takes on average; no fewer tasks than the cluster has cores.
EDGES_A_TASK = 100_000


def _stars(edges: DataFrame) -> bool:
    """Whether each node of edges(u, v) is either a leaf with one edge, as u, or a centre, as v."""
    leaf, centre = F.lit(1).alias("leaf"), F.lit(0).alias("leaf")
    ends = edges.select(F.col("u").alias("x"), leaf).unionByName(edges.select(F.col("v").alias("x"), centre))
    seen = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
    return seen.filter("leaf > 1 or (leaf = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a, b): its component's smallest node. Alternates large-star and small-star."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "join-edges")
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // EDGES_A_TASK))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u != v").distinct(), "join-large", parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u != v").distinct(), "join-small", parts)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of roots that pairs (a, b) of nodes connect; pairs of one root are left out."""
    for end in ("a", "b"):
        at = roots.select(F.col("node").alias(end), F.col("root").alias("to"))
        pairs = pairs.join(at, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return pairs.filter("a != b").select("a", "b").distinct()


def _linked(side: np.ndarray, texts: pa.Array, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of side 0, rows of side 1 (where there is no side 1: the same), and the matrix of who is linked to whom."""
    grams, starts = ngrams(texts, n)
    own = np.repeat(np.arange(len(side)), np.diff(starts))
    by = np.lexsort((grams, own))
    grams, own = grams[by], own[by]
    new = np.ones(len(by), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    grams, own = grams[new], own[new]
    sizes = np.bincount(own, minlength=len(side))
    one = not side.any()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if one else 1))
    place = np.zeros(len(side), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    _, code = np.unique(grams, return_inverse=True)
    on_left, on_right = (np.bincount(code, weights=side[own] == k, minlength=code.max(initial=-1) + 1) for k in (0, 1))
    shared = on_left > 1 if one else (on_left > 0) & (on_right > 0)
    take = shared[code]
    code, own = (np.cumsum(shared) - 1)[code[take]], own[take]
    by = np.argsort(code, kind="stable")
    code, own = code[by], own[by]
    common = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact up to 2^24
    for begin in range(0, int(shared.sum()), COLUMNS_A_PRODUCT):
        lo, hi = np.searchsorted(code, [begin, begin + COLUMNS_A_PRODUCT])
        x = np.zeros((len(left), COLUMNS_A_PRODUCT), np.float32)
        y = x if one else np.zeros((len(right), COLUMNS_A_PRODUCT), np.float32)
        c, o = code[lo:hi] - begin, own[lo:hi]
        first = side[o] == 0
        x[place[o[first]], c[first]] = 1
        if not one:
            y[place[o[~first]], c[~first]] = 1
        common += x @ y.T
    either = sizes[left][:, None] + sizes[right][None, :] - common.astype(np.float64)
    linked = (common / np.maximum(either, 1) >= threshold) & (either > 0)
    if one:
        np.fill_diagonal(linked, False)
    return left, right, linked


def _count(n: int, threshold: float):
    """For each node of a task, how many nodes of the other block (of its own block, where there is one only) it is linked to."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").combine_chunks())
        left, right, linked = _linked(side, table.column("text").combine_chunks(), n, threshold)
        many = np.zeros(len(side), np.int64)
        many[left] = linked.sum(axis=1)
        if side.any():
            many[right] = linked.sum(axis=0)
        return pa.table([table.column("node"), pa.array(many)], names=["node", "n_links"])

    return run


def _forest(n: int, threshold: float):
    """Edges (a, b) that join what a task's links join; no more than it has nodes."""

    def run(table: pa.Table) -> pa.Table:
        node, label = table.column("node").combine_chunks(), np.arange(len(table))
        if len(table.column("root").unique()) > 1:
            side = np.asarray(table.column("side").combine_chunks())
            left, right, linked = _linked(side, table.column("text").combine_chunks(), n, threshold)
            i, j = np.nonzero(linked)
            i, j = left[i], right[j]
            while True:  # each takes the smallest label around it
                before = label.copy()
                np.minimum.at(label, i, label[j])
                np.minimum.at(label, j, label[i])
                if (label == before).all():
                    break
        rows = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([node.take(pa.array(rows)), node.take(pa.array(label[rows]))], names=["a", "b"])

    return run


def dealt(f: DataFrame, group: str, block_texts: int, block_grams: int) -> DataFrame:
    """Rows of f with the tasks (level, a, up, b) in which each takes part, and its side there. f: node, size, level and a group.

    The nodes of a group and level are dealt into blocks; a task compares two blocks of one level or of two that follow
    each other (up), or one block with itself.
    """
    levels = f.groupBy(group, "level").agg(F.count("*").alias("texts"), F.sum("size").alias("grams"))
    many = F.ceil(F.greatest(F.col("texts") / F.lit(block_texts), F.col("grams") / F.lit(block_grams))).cast("int")
    levels = levels.select(group, F.struct("level", F.greatest(many, F.lit(1)).alias("blocks")).alias("x"))
    levels = levels.groupBy(group).agg(F.map_from_entries(F.collect_list("x")).alias("blocks"))
    f = f.join(levels, group)
    count = lambda level: F.coalesce(F.try_element_at("blocks", level), F.lit(0))
    f = f.withColumn("block", F.pmod(F.xxhash64("node"), count(F.col("level"))).cast("int"))
    level, block = F.col("level"), F.col("block")

    def tasks(other: Column, make) -> Column:
        listed = F.when(count(other) > 0, F.sequence(F.lit(0), count(other) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(listed, lambda c: F.struct(*[x.cast("int").alias(k) for k, x in zip(("level", "a", "up", "b", "side"), make(c))]))

    within = tasks(level, lambda c: (level, F.least(block, c), F.lit(0), F.greatest(block, c), (block > c)))
    above = tasks(level + 1, lambda c: (level, block, F.lit(1), c, F.lit(0)))
    below = tasks(level - 1, lambda c: (level - 1, c, F.lit(1), block, F.lit(1)))
    return f.withColumn("x", F.explode(F.concat(within, above, below))).select(*[c for c in f.columns if c not in ("level", "block", "blocks")], "x.*")


def degrees(placed: DataFrame, texts: DataFrame, n: int, threshold: float, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(node, n_links) of the nodes of placed(node, root, size): the nodes of the same root at or above the threshold."""
    # Sizes in one step of this scale, or in two that follow each other, may be close enough; others can't.
    width = max(float(np.log(1 / threshold)), 1e-3) * 1.000001
    whole = placed.groupBy("root").agg(F.count("*").alias("texts"), F.sum("size").alias("grams"))
    f = placed.join(whole.filter("texts > 1"), "root")
    small = (F.col("texts") <= block_texts) & (F.col("grams") <= block_grams)
    f = f.withColumn("level", F.when(small, 0).otherwise(F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(width)).cast("int")))
    f = stored(f.select("node", "root", "size", "texts", "level"), "join-classes")
    pairs = f.filter("texts = 2").select("node", F.lit(1).cast("long").alias("n_links"))  # the link that made the class
    tasks = dealt(f.filter("texts > 2").select("node", "root", "size", "level"), "root", block_texts, block_grams)
    counted = bounded_batches(tasks.join(texts, "node")).groupBy("root", "level", "a", "up", "b").applyInArrow(_count(n, threshold), "node binary, n_links long")
    return pairs.unionByName(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def apart(members: DataFrame, found: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, node, root, size, d, level, many) of what step 4 still has to compare: d is the distance to the bucket's pivot, many how many the bucket has."""
    width = 1 - threshold + 1e-9
    rings = int(1 / width) + 2
    at = found.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("j")).alias("d"))
    f = members.filter("node != pivot").join(at, ["node", "pivot"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    f = stored(f.select("key", "node", "root", "d", F.floor(F.col("d") / F.lit(width)).cast("int").alias("level")), "join-rings")
    ring = lambda k, x: F.when(F.col("level") == k, x)
    facts = [F.struct(F.min(ring(k, F.col("root"))).alias("lo"), F.max(ring(k, F.col("root"))).alias("hi")).alias(f"r{k}") for k in range(rings)]
    seen = f.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *facts).filter("lo != hi")
    seen = seen.select("key", F.array(*[f"r{k}" for k in range(rings)]).alias("ring"))
    other = lambda x: x["lo"].isNotNull() & ((x["lo"] != F.col("root")) | (x["hi"] != F.col("root")))
    around = F.exists(F.slice("ring", F.greatest(F.col("level"), F.lit(1)), F.when(F.col("level") > 0, 3).otherwise(2)), other)
    f = f.join(seen, "key").filter(around).drop("ring").join(nodes.select("node", "size"), "node")
    f = stored(f, "join-around")
    return f.join(f.groupBy("key").agg(F.count("*").alias("many")), "key")


def late_links(rest: DataFrame, texts: DataFrame, n: int, threshold: float, few: int = FEW, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Edges (a, b) between components that the links among rest (of apart) join."""
    rest = stored(rest, "join-apart")
    side = lambda x: rest.filter(F.col("many") <= few).select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "d")])
    close = (F.least("size_a", "size_b") >= F.lit(threshold - 1e-9) * F.greatest("size_a", "size_b")) & (F.abs(F.col("d_a") - F.col("d_b")) <= F.lit(1 - threshold + 1e-9))
    met = side("a").join(side("b"), "key").filter((F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & close)
    pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    edges = verified(pairs, texts, n, "join-late").filter(F.col("j") >= threshold).select("a", "b")
    # Ring 0 is linked to the pivot: one component.
    tasks = dealt(rest.filter(F.col("many") > few).select("key", "node", "root", "size", "level"), "key", block_texts, block_grams).filter("level > 0 or up = 1")
    more = bounded_batches(tasks.join(texts, "node")).groupBy("key", "level", "a", "up", "b").applyInArrow(_forest(n, threshold), "a binary, b binary")
    return stored(edges.unionByName(more), "join-late-edges")


def classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (node, doc_id) of all documents, (node, root, size, class_id, n_copies) of all nodes, and the texts of nodes that share a bucket."""
    bands, rows = bands_for(threshold, recall)
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("node", F.unhex(F.md5("text")))
    kind = dict(base.dtypes)["doc_id"]
    signed = stored(bounded_batches(base).mapInArrow(_sign(n, bands, rows), f"node binary, doc_id {kind}, size long, bands array<bigint>"), "join-signed")
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "join-nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("many")).filter("many > 1")
    members = stored(keys.join(crowded, "key"), "join-members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("own")), "node")
    rows_of = base.join(wanted, "node").filter(F.col("doc_id").eqNullSafe(F.col("own")))
    texts = stored(rows_of.select("node", "text").dropDuplicates(["node"]), "join-texts")

    parts = F.ceil(F.max("many") / F.lit(PAIRS_OF_PIVOT)).cast("long").alias("parts")
    pairs = members.filter("node != pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(parts)
    pivots = members.filter("node = pivot").groupBy(F.col("node").alias("b")).agg(parts)
    found = verified(pairs, texts, n, "join-pairs", pivots)
    roots = stored(components(found.filter(F.col("j") >= threshold)), "join-roots")
    more = late_links(apart(members, found, roots, nodes, threshold), texts, n, threshold)

    placed = nodes.select("node", "own", "n_copies", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not more.isEmpty():
        moved = stored(components(between(more, roots)).select(F.col("node").alias("root"), F.col("root").alias("to")), "join-moved")
        placed = placed.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
    smallest = placed.groupBy("root").agg(F.min("own").alias("class_id"))
    return signed.select("node", "doc_id"), placed.join(smallest, "root").select("node", "root", "size", "class_id", "n_copies"), texts


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows (node, doc_id, class_id, n_links, n_copies) of all documents."""
    rows, placed, texts = classes(docs, n, threshold, recall)
    placed = stored(placed, "join-placed-all")
    degree = stored(degrees(placed.select("node", "root", "size"), texts, n, threshold), "join-degrees")
    placed = placed.join(degree, "node", "left")
    return rows.join(placed.select("node", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies"), "node")


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return join(documents).drop("node")


def keep_documents(documents: DataFrame, **how) -> DataFrame:
    """One document of each class: that with the class's id. Repeated rows of it are one; null doc_ids that are alone stay."""
    rows, placed, _ = classes(documents, **how)
    rows = rows.join(placed.select("node", "class_id"), "node")
    node = F.unhex(F.md5(text_or_empty()))
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("node", F.col("doc_id").alias("first")).distinct()
    kept = documents.select("doc_id", "text", "lang", "source", "n_chars", node.alias("node"))
    kept = kept.join(first, (kept["node"] == first["node"]) & kept["doc_id"].eqNullSafe(first["first"])).drop(first["node"])
    return kept.dropDuplicates(["node", "doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
