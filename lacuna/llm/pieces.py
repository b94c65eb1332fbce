"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

A text becomes characters, a blank the mark U+2581, and one mark is put before it. Adjacent symbols are merged in the
order of the merged piece's score, leftmost first among equals: an agenda that holds the adjacent pairs. As no piece
has a mark after another character, a text falls into segments (marks, then other characters) that never merge with
each other; a worker keeps the ids of the segments it has met, up to a fixed number. What no piece covers becomes
its UTF-8 bytes' pieces.

Every segment that the agenda encodes is checked against the sentencepiece library in the batch that brings it, and
decoding is the library's decode. A vocabulary of another kind, or with another normaliser, is refused.

Defined results: a null text counts as empty and has the begin and end ids only; null doc_id and repeated rows are
kept row by row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, worker_cache

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Segments of a generation; a worker keeps two generations, and what is met again moves to the younger.
KEPT = 400_000
#: Up to so many symbols the agenda is a plain list, beyond it a heap.
SHORT = 24
#: A vocabulary of at most this size is sent to the workers.
MODEL_BYTES = 64 << 20


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        # Rank: equal scores are equal.
        levels = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: levels[s] for p, s in self.scores.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos, self.kept = sp.bos_id(), sp.eos_id(), {}
        self.older: dict[str, bytes] = {}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark after another character: segments would merge")
        if not all(sp.is_byte(b) for b in self.bytes):
            raise ValueError("the vocabulary has no byte pieces")
        if sp.encode("a  bﬁ ") != self.segments_ids("a  bﬁ "):
            raise ValueError("not a merge-type vocabulary with the identity normaliser and a leading mark")

    def merge(self, segment: str) -> list[str]:
        return self._short(list(segment)) if len(segment) <= SHORT else self._long(list(segment))

    def _short(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank, 1 << 60
        agenda = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != piece:
                continue  # one of the pair has merged meanwhile
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(both := piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, both))
            h = before[i]
            if h >= 0 and (r := rank.get(both := symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (r, h, both))
        return [s for s in symbols if s]

    def segment(self, segment: str) -> list[int]:
        out = []
        for piece in self.merge(segment):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in piece.encode("utf-8"))
        return out

    def segments_ids(self, text: str) -> list[int]:
        return [i for s in SEGMENT.findall(MARK + text.replace(" ", MARK)) for i in self.segment(s)] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        absent = [s for s in set().union(*split) if s not in kept]
        kept.update((s, older[s]) for s in absent if s in older)
        new = [s for s in absent if s not in kept]
        own = [self.segment(s) for s in new]
        theirs = self.library.encode([s[1:].replace(MARK, " ") for s in new], num_threads=1) if new else []
        for s, a, b in zip(new, own, theirs):
            if a != b and s != MARK:  # a lone mark would be an empty text to the library
                raise ValueError(f"agenda and library differ on {s[:80]!r}")
            kept[s] = struct.pack(f"<{len(a)}I", *a)
        first, last = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        return [first + b"".join([kept[s] for s in x]) + last for x in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([list(memoryview(x).cast("I")) for x in ids], num_threads=1)


def coder(model: bytes) -> Coder:
    coders, key = worker_cache("pieces"), hashlib.sha256(model).digest()
    if key not in coders:
        coders.clear()
        coders[key] = Coder(model)
    return coders[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Characters of text that are encoded at once.
STEP = 1_000_000


def _runs(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, ids (array; null unless asked for), n_tokens, ids_sha256, decoded (null unless asked for) and decoded_sha256."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the vocabulary has {len(model)} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c = coder(sent.value)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in _runs(texts):
                coded = c.encode(texts[a:b])
                decoded = c.decode(coded)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                cols = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([list(memoryview(x).cast("I")) if ids else None for x in coded], pa.list_(pa.int32())),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([sha(x) for x in coded]),
                    pa.array([x if ids else None for x in decoded], pa.string()),
                    pa.array([sha(x.encode("utf-8")) for x in decoded]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string"
    return bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return encode(documents, ids=False).drop("ids", "decoded")
