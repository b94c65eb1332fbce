"""Quality rules: text statistics and the perplexity of a modified Kneser-Ney n-gram model.

The n-grams are of characters, over the running text: each character of a word, and the blank after it, is predicted
from the `order - 1` characters before it, which reach back over the blank into the end of the word before (start
marks stand before a text, and fill up where that word is too short). The perplexity is that of a word: the mean
negative log probability that a document's words have, blanks included.

Spark counts the n-grams by language over every document, derives the continuation counts of the lower orders, the
three discounts of each order and language, and the interpolated probabilities and back-off weights. The table of all
n-grams stays a Spark table and grows with the corpus. Of the highest order, one n-gram (the most frequent) for each of
`slots` hash slots goes to the workers as sorted arrays of 64-bit hashes and values; that bound allows the broadcast,
and decides nothing but speed: n-grams that a worker doesn't find are handed on with their counts, and joined with the
whole table by language and n-gram.

In each language a band around the quartiles of the scores, `reach` times their distance wide below and above, bounds
what is kept.

Defined results: a null text has no words, and fails; a null lang is a language of its own; null doc_id and repeated
rows are kept row by row; an empty table gives an empty result; further columns are not read. A document without
words has no score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, mixed, small_side, steps, stored, sums_by_text, text_of, words_of, worker_cache

ORDER = 4
#: n-grams of the highest order that go to the workers, at most.
SLOTS = 1 << 19
#: The band, in distances between the language's own quartiles: below the first and above the third.
REACH = (1.75, 3.0)
START = "\x02"
#: Words that a worker gathers before it hands their n-grams on.
GATHER = 400_000
BLANKS = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- counting


@dataclass
class Pieces:
    """What the words of a batch predict. inner: strings whose n-grams lie within a word (and its blank), by `word`, the
    place of each word's string; edge: strings whose n-grams begin before the word, by `pair`, likewise."""

    inner: list[str]
    word: np.ndarray
    edge: list[str]
    pair: np.ndarray


def pieces(words: pa.Array, offsets: np.ndarray, order: int) -> Pieces:
    """Each word's characters and blank: the first order - 1 of them depend on the word before, the others on the word alone."""
    if not len(words):
        return Pieces([], np.zeros(0, np.int64), [], np.zeros(0, np.int64))
    coded = words.dictionary_encode()
    word, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    tails = pa.array([w[-(order - 2) :].rjust(order - 2, START) + " " if order > 2 else " " for w in distinct] + [START * (order - 1)]).dictionary_encode()
    heads = pa.array([(w + " ")[: order - 1] for w in distinct]).dictionary_encode()
    tail, head = np.asarray(tails.indices).astype(np.int64), np.asarray(heads.indices).astype(np.int64)
    before = np.full(len(word), len(distinct))
    before[1:] = word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = len(distinct)  # the last tail is that of a text's beginning
    n = len(heads.dictionary)
    codes, pair = np.unique(tail[before] * n + head[word], return_inverse=True)
    t, h = tails.dictionary.to_pylist(), heads.dictionary.to_pylist()
    return Pieces([w + " " for w in distinct], word, [t[c // n] + h[c % n] for c in codes.tolist()], pair)


def windows(strings: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings; where each of their n-grams ends; whose string it is."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    many = np.maximum(lengths - (order - 1), 0)
    owner = np.repeat(np.arange(len(strings)), many)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return codes, (np.cumsum(lengths) - lengths)[owner] + order - 1 + within, owner


def hashes(codes: np.ndarray, ends: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Of the n code points that end at each place."""
    h = np.full(len(ends), np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    for k in range(n - 1, -1, -1):
        h = (h ^ codes[ends - k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mixed(h)


def seed_of(lang: str) -> int:
    return zlib.crc32(lang.encode("utf-8", "surrogatepass")) * 1_000_003


def gram_texts(codes: np.ndarray, ends: np.ndarray, order: int) -> list[str]:
    block = np.stack([codes[ends - k] for k in range(order - 1, -1, -1)], axis=1).astype("<u4")
    text = block.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + order] for i in range(0, len(text), order)]


def _count(order: int):
    def flush(held: dict[str, list]) -> pa.RecordBatch:
        langs, grams, counts = [], [], []
        for lang, parts in held.items():
            strings = [s for strings, _ in parts for s in strings]
            weights = np.concatenate([w for _, w in parts])
            codes, ends, owner = windows(strings, order)
            _, first, inverse = np.unique(hashes(codes, ends, order, 0), return_index=True, return_inverse=True)
            counts.append(np.bincount(inverse, weights=weights[owner], minlength=len(first)).astype(np.int64))
            grams += gram_texts(codes, ends[first], order)
            langs += [lang] * len(first)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

    def run(batches):
        worker_cache("quality")
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for step in steps(batch):
                for lang, _, words, offsets in by_lang(step.column("text"), step.column("lang").to_pylist()):
                    p = pieces(words, offsets, order)
                    mine = held.setdefault(lang, [])
                    mine.append((p.inner, np.bincount(p.word, minlength=len(p.inner)).astype(float)))
                    mine.append((p.edge, np.bincount(p.pair, minlength=len(p.edge)).astype(float)))
                    size += len(p.inner) + len(p.edge)
                if size >= GATHER:
                    yield flush(held)
                    held, size = {}, 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield flush(held)

    return run


def by_lang(texts: pa.Array, langs: list[str]):
    """For each language: its name, its rows, their words, and where each row's words begin (one more for the end); rows without words are left out."""
    words, offsets = words_of(texts)
    sizes = np.diff(offsets)
    for lang in sorted(set(langs)):
        mine = np.fromiter((x == lang for x in langs), bool, len(langs)) & (sizes > 0)
        if mine.all():
            yield lang, np.arange(len(langs)), words, offsets
        elif mine.any():
            yield lang, np.flatnonzero(mine), words.filter(pa.array(np.repeat(mine, sizes))), np.concatenate([[0], np.cumsum(sizes[mine])])


def with_lang(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"))


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram and n: the n-grams of the highest order in all texts of all documents."""
    found = bounded_batches(with_lang(docs)).select("text", "lang").mapInArrow(_count(order), "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- model


def discounts(level: DataFrame) -> DataFrame:
    """For each language of a level: types, and what an n-gram that was counted once, twice or more often gives off."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4))
    d = level.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"), F.count("*").alias("types"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    put = lambda x, other: F.greatest(F.lit(0.05), F.least(F.coalesce(x, F.lit(other)), F.lit(other + 0.45)))
    return d.select(
        F.col("lang").alias("l"),
        "types",
        put(1 - 2 * y * F.try_divide(F.col("n2"), F.col("n1")), 0.5).alias("d1"),
        put(2 - 3 * y * F.try_divide(F.col("n3"), F.col("n2")), 1.0).alias("d2"),
        put(3 - 4 * y * F.try_divide(F.col("n4"), F.col("n3")), 1.5).alias("d3"),
    )


def kneser_ney(top: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """By length k, lang, gram, value and weight (count) of the n-grams: the natural log of the probability of the last
    character after the others; by -k, of contexts of k characters: the log of their back-off weight. At 0 the weight
    for a character that a language has never shown."""
    levels = {order: stored(top, f"quality-count{order}")}
    for k in range(order - 1, 0, -1):  # in how many ways an n-gram is continued to the left
        levels[k] = stored(levels[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), f"quality-count{k}")
    every = None
    for k, level in levels.items():
        d = discounts(level).withColumn("k", F.lit(k))
        every = d if every is None else every.unionByName(d)
    every = stored(every, "quality-discounts")
    out, below = {}, None
    for k in range(1, order + 1):
        c = levels[k].join(small_side(every.filter(F.col("k") == k).drop("k")), F.col("lang") == F.col("l")).drop("l")
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.withColumn("off", F.least(off, F.col("n").cast("double"))).withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        t = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("taken"), F.max("types").alias("types"))
        t = stored(t.select(F.col("lang").alias("l"), F.col("context").alias("h"), "total", (F.col("taken") / F.col("total")).alias("gamma"), F.col("types").alias("kinds")), f"quality-context{k}")
        # One context a language at k = 1: as few rows as there are languages.
        p = c.join(small_side(t) if k == 1 else t, (c["lang"] == t["l"]) & (c["context"] == t["h"])).drop("l", "h")
        first = (F.col("n") - F.col("off")) / F.col("total")
        if below is None:
            p = p.withColumn("p", first + F.col("gamma") / (F.col("kinds") + 1))
        else:
            low = below.select(F.col("lang").alias("l"), F.col("gram").alias("g"), F.exp("value").alias("q"))
            p = p.join(low, (p["lang"] == low["l"]) & (F.expr("substring(gram, 2)") == low["g"]), "left")
            p = p.withColumn("p", first + F.col("gamma") * F.coalesce("q", F.lit(0.0)))
        out[k] = below = stored(p.select("lang", "gram", F.ln("p").alias("value"), F.col("n").alias("weight")), f"quality-p{k}")
        gamma = F.col("gamma") / (F.col("kinds") + 1) if k == 1 else F.col("gamma")
        out[-(k - 1)] = t.select(F.col("l").alias("lang"), F.col("h").alias("gram"), F.ln(gamma).alias("value"), F.col("total").cast("long").alias("weight"))
    return out


def log_probabilities(grams: DataFrame, model: dict[int, DataFrame], order: int) -> DataFrame:
    """lang, gram and log for each of grams(lang, gram): the model's value, or that of the longest shorter n-gram with the back-off weights on the way."""
    out = grams.select("lang", "gram", F.lit(0.0).alias("log"), F.lit(False).alias("done"))
    for k in range(order, 0, -1):
        own = model[k].select(F.col("lang").alias("l"), F.col("gram").alias("g"), "value")
        out = out.join(own, (F.col("lang") == F.col("l")) & (F.substring("gram", order - k + 1, k) == F.col("g")), "left")
        got = ~F.col("done") & F.col("value").isNotNull()
        out = out.select("lang", "gram", F.when(got, F.col("log") + F.col("value")).otherwise(F.col("log")).alias("log"), (F.col("done") | got).alias("done"))
        off = model[-(k - 1)].select(F.col("lang").alias("l"), F.col("gram").alias("g"), "value")
        off = small_side(off) if k == 1 else off
        out = out.join(off, (F.col("lang") == F.col("l")) & (F.substring("gram", order - k + 1, k - 1) == F.col("g")), "left")
        out = out.select("lang", "gram", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") + F.coalesce("value", F.lit(0.0))).alias("log"), "done")
    return out.select("lang", "gram", F.when(F.col("done") | (F.col("log") != 0), F.col("log")).otherwise(F.lit(-10.0)).alias("log"))


@dataclass
class Known:
    """Sorted hashes of n-grams of the highest order, and their log probabilities."""

    order: int
    keys: np.ndarray
    values: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h
        return hit, np.where(hit, self.values[at], 0.0)

    def strings(self, strings: list[str], lang: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The log probability of each string's known n-grams; for each unknown one, whose it is, and its text."""
        codes, ends, owner = windows(strings, self.order)
        h, back = np.unique(hashes(codes, ends, self.order, seed_of(lang)), return_inverse=True)
        hit, value = self.find(h)
        log = np.bincount(owner, weights=value[back], minlength=len(strings))
        lost = np.flatnonzero(~hit[back])
        return log, owner[lost], gram_texts(codes, ends[lost], self.order) if len(lost) else []


def known(top: DataFrame, order: int = ORDER, slots: int = SLOTS) -> Known:
    """At most `slots` n-grams of the highest order come to the driver: of each hash slot the most frequent."""
    slot = F.pmod(F.xxhash64("lang", "gram"), F.lit(slots))
    won = top.groupBy(slot.alias("slot")).agg(F.max(F.struct("weight", "lang", "gram", "value")).alias("x"))
    got = won.select("x.lang", "x.gram", "x.value").toArrow()
    langs, grams = got.column("lang").to_pylist(), got.column("gram").to_pylist()
    values = got.column("value").to_numpy().astype(np.float64)
    keys = np.zeros(len(grams), np.uint64)
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang, mine in rows.items():
        codes, ends, _ = windows([grams[i] for i in mine], order)
        keys[mine] = hashes(codes, ends, order, seed_of(lang))
    by = np.argsort(keys)
    return Known(order, keys[by], values[by])


# ---------------------------------------------------------------- statistics and scores


def repeated(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how many words lie in 3-word windows that it has twice or more."""
    n = len(ids)
    covered = np.zeros(n, np.int64)
    if n >= 3:
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.flatnonzero(text[2:] == text[:-2])
        a, b, c, t = ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64), ids[at + 2].astype(np.uint64), text[at]
        h = mixed(mixed(mixed(t.astype(np.uint64) << np.uint64(32) | a) + b) + c)
        by = np.argsort(h, kind="stable")
        x, y = by[:-1], by[1:]
        same = (h[x] == h[y]) & (a[x] == a[y]) & (b[x] == b[y]) & (c[x] == c[y]) & (t[x] == t[y])
        hit = np.zeros(len(at), bool)
        hit[x[same]] = True
        hit[y[same]] = True
        first = at[hit]
        covered[first] = covered[first + 1] = covered[first + 2] = 1
    return sums_by_text(covered, offsets)


def dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
REST = T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())]))


def _by_text(rows: np.ndarray, grams: list[str], count: int) -> pa.Array:
    """For each of count texts a list of (gram, n): how often it has each of the grams at its rows."""
    coded = pa.array(grams, pa.string()).dictionary_encode()
    n = max(1, len(coded.dictionary))
    codes, many = np.unique(rows * n + np.asarray(coded.indices).astype(np.int64), return_counts=True) if len(grams) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.searchsorted(codes // n, np.arange(count + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(codes % n)), pa.array(many.astype(np.int64))], names=["gram", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def _measure(sent, column: str):
    def run(batches):
        worker_cache("quality")
        model = sent.value
        for batch in batches:
            for step in steps(batch, column):
                texts, langs = text_of(step, column), step.column("lang").to_pylist()
                words, offsets = words_of(texts)
                coded = words.dictionary_encode()
                ids, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
                chars = np.asarray(pc.utf8_length(distinct)).astype(np.int64)
                marks = np.asarray(pc.count_substring_regex(distinct, r"[#*$%&|<>]")).astype(np.int64)
                log, lost_rows, lost_grams = np.zeros(len(texts)), [], []
                for lang, rows, mine, begins in by_lang(texts, langs):
                    own = np.repeat(rows, np.diff(begins))
                    p = pieces(mine, begins, model.order)
                    for strings, at in ((p.inner, p.word), (p.edge, p.pair)):
                        value, owner, grams = model.strings(strings, lang)
                        log += np.bincount(own, weights=value[at], minlength=len(texts))
                        if grams:  # each word that has such a string hands its n-grams on
                            by = np.argsort(at, kind="stable")
                            lo, hi = np.searchsorted(at[by], owner), np.searchsorted(at[by], owner, side="right")
                            many = hi - lo
                            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                            lost_rows.append(own[by[place]])
                            lost_grams += np.repeat(np.array(grams, object), many).tolist()
                rest = _by_text(np.concatenate(lost_rows) if lost_rows else np.zeros(0, np.int64), lost_grams, len(texts))
                facts = [np.diff(offsets), sums_by_text(chars[ids], offsets), sums_by_text(marks[ids], offsets), np.fromiter(map(dup_lines, texts.to_pylist()), np.int64, len(texts)), repeated(ids, offsets)]
                cols = [step.column("row")] + [pa.array(x) for x in facts] + [pa.array(log), rest, step.column("lang")]
                yield pa.RecordBatch.from_arrays(cols, names=["row", *STATS.fieldNames(), "log", "rest", "lang"])

    return run


def measured(docs: DataFrame, model: dict[int, DataFrame], carry: list[str], order: int = ORDER, slots: int = SLOTS, corpus: bool = True) -> DataFrame:
    """row (a struct of the carried columns), the statistics, score and lang (never null) for each document.

    corpus: the documents are those of the model, so that it has all their n-grams; else unknown ones back off.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known(model[order], order, slots))
    rows = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    column = "row.text" if "text" in carry else "text"
    rows = rows.drop("text") if "text" in carry else rows  # a carried text is not sent twice
    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), *STATS.fields, T.StructField("log", T.DoubleType()), T.StructField("rest", REST), T.StructField("lang", T.StringType())])
    out = stored(bounded_batches(rows).mapInArrow(_measure(sent, column), schema).withColumn("id", F.monotonically_increasing_id()), "quality-measured")
    # Documents with n-grams that the workers didn't have: these meet the whole table, without the texts.
    some = F.size("rest") > 0
    rest = out.filter(some).select("id", "lang", F.explode("rest").alias("x")).select("id", "lang", "x.gram", "x.n")
    if corpus:
        logs = model[order].select("lang", "gram", F.col("value").alias("log"))
    else:
        logs = log_probabilities(stored(rest.select("lang", "gram").distinct(), "quality-rest"), model, order)
    more = rest.join(logs, ["lang", "gram"]).groupBy("id").agg(F.sum(F.col("n") * F.col("log")).alias("more"))
    score = lambda log: F.when(F.col("n_words") > 0, -log / F.col("n_words")).alias("score")
    facts = ["row", *STATS.fieldNames(), "lang"]
    whole = out.filter(~some).select(*facts, score(F.col("log")))
    return whole.unionByName(out.filter(some).join(more, "id").select(*facts, score(F.col("log") + F.col("more"))))


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, carry: list[str], order: int = ORDER, slots: int = SLOTS, reach: tuple[float, float] = REACH) -> DataFrame:
    """What measured() gives, with base_failed, lower, upper and kept."""
    rows = measured(docs, kneser_ney(counts(docs, order), order), carry, order, slots).withColumn("base_failed", failed())
    q = rows.filter("score is not null and not base_failed").groupBy("lang").agg(F.percentile_approx("score", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias("q"))
    low, high, wide = F.col("q")[0], F.col("q")[1], F.col("q")[1] - F.col("q")[0]
    # Scores that are all alike leave no distance: a least one keeps the band open.
    wide = F.greatest(wide, F.lit(0.1))
    bands = stored(q.select(F.col("lang").alias("of"), (low - wide * reach[0]).alias("lower"), (high + wide * reach[1]).alias("upper")), "quality-bands")
    out = rows.join(small_side(bands), F.col("lang") == F.col("of"), "left").drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score").between(F.col("lower"), F.col("upper")), F.lit(False)))


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return judge(documents, ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("score").alias("log_perplexity"), "lower", "upper"
    )


def keep_documents(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return judge(documents, columns).filter("kept").select("row.*")
