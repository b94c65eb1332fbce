"""What the training-data operators share: tables, words, and steps of bounded size."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.scratch import scratch, shared_dir, small_side, stored  # noqa: F401 - the operators take them from here

#: White space that separates words; every other character belongs to a word.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text that is not null."""
    return F.size(F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")).cast("long")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, and for each text the place of its first word (one more for the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, bool)
    if len(full) and not full.all():  # a text's first and last piece may be empty
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The cache of an operator in this Python worker. A worker serves many operators; it keeps the last one's cache only."""
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _kept.setdefault(owner, {})


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session's Arrow batches stay small, also where texts are long, unless the user set their size."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return df


#: Bytes of text that a Python worker takes at once.
STEP_BYTES = 4 << 20


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column of texts; "row.text" is a field of the struct column row."""
    top, *inner = column.split(".")
    return pc.struct_field(batch.column(top), inner).cast(pa.string()) if inner else batch.column(top)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES):
    """The batch in slices of at most about `most` bytes of text (one row at least)."""
    texts = text_of(batch, column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
