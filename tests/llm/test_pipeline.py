"""The stages, each on its own input, and what the whole run keeps."""

import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from lacuna.llm import mixing, pieces, quality, secrets

from .test_operators import PROSE, SCHEMA, brute_kneser_ney, brute_quality, brute_targets, docs, empty, grams_of, make, shingles  # noqa: F401 - docs and empty are fixtures

WORD = re.compile(r"[^ \t-\r]+")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    good = pipeline.keep_quality(spark, docs, DATA).toPandas()
    assert set(good.columns) == set(docs.columns)
    assert good.text.map(lambda t: len(WORD.findall(t))).min() >= 50
    one = pipeline.drop_near_duplicates(spark, spark.createDataFrame(good), DATA).toPandas()
    assert one.text.is_unique and set(one.doc_id) <= set(good.doc_id) and 0 < len(one) <= len(good)
    masked = pipeline.mask_secrets(spark, spark.createDataFrame(one), DATA).toPandas()
    assert len(masked) == len(one) and not masked.text.str.contains(r"[0-9a-f]{32}").any()
    mixed = pipeline.mix_sources(spark, spark.createDataFrame(masked), DATA).toPandas()
    assert mixed.doc_id.value_counts().max() <= 3 and set(mixed.columns) == set(docs.columns)
    coded = pipeline.encode_pieces(spark, spark.createDataFrame(mixed), DATA).toPandas()
    assert len(coded) == len(mixed) and (coded.ids.map(len) == coded.n_tokens).all()


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, docs):  # noqa: F811
    """docs, with enough good, bad and nearly equal texts for each stage to decide something; repeated rows and nulls."""
    rng = np.random.default_rng(21)
    words = [w for w in PROSE.split()] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(100, 160):
        text = " ".join(rng.choice(words, 70))
        rows.append((i, text, ("en", "de", None)[i % 3], f"s{i % 4}"))
        if i % 10 == 0:
            rows.append((i + 1000, text.replace(text.split()[30], "zz", 1) if i % 20 else text, ("en", "de", None)[i % 3], None))
    rows += [(300 + i, " ".join("".join(map(chr, rng.integers(0x4E00, 0x9000, 9))) for _ in range(70)), "en", "s1") for i in range(2)]
    rows += [rows[0], rows[0], (None, rows[3][1] + " token=abcdefghij12", "en", "s2")]
    return docs.unionByName(make(spark, rows)).cache()


def plain(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("reach", [quality.REACH, (0.3, 0.3)])  # a narrow band decides much on a small table
def test_quality_stage(spark, corpus, empty, reach, monkeypatch):  # noqa: F811
    monkeypatch.setattr(quality, "judge", lambda *a, whole=quality.judge: whole(*a, reach=reach))
    rows = [tuple(r) for r in corpus.select(*COLUMNS).collect()]
    order, logs, score = quality.ORDER, {}, {}
    for lang in {r[2] for r in rows}:
        logs[lang] = brute_kneser_ney([r[1] or "" for r in rows if r[2] == lang], order)
    for r in rows:
        facts = brute_quality(r[1] or "")
        score[r] = None if facts[-1] else -sum(map(logs[r[2]], grams_of(r[1], order))) / facts[0]
    want = Counter()
    for lang in logs:
        mine = sorted(score[r] for r in rows if r[2] == lang and score[r] is not None)
        if mine:
            low, high = (mine[max(0, int(np.ceil(p * len(mine))) - 1)] for p in (0.25, 0.75))
            wide = max(high - low, 0.1)
            want += Counter(r for r in rows if r[2] == lang and score[r] is not None and low - reach[0] * wide <= score[r] <= high + reach[1] * wide)
    got = pipeline.keep_quality(spark, corpus, "")
    assert plain(got) == want and sum(want.values()) > 0
    assert reach == quality.REACH or sum(want.values()) < sum(s is not None for s in score.values()) - 10
    assert pipeline.keep_quality(spark, empty, "").count() == 0


def test_near_duplicate_stage(spark, corpus, empty):  # noqa: F811
    rows = sorted({tuple(r) for r in corpus.select(*COLUMNS).collect()}, key=str)
    sets, parent = [shingles(r[1] or "") for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) / len(a | b) >= 0.8:
                parent[root(i)] = root(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i), []).append(r[0])
    want = Counter(min((x for x in c if x is not None), default=None) for c in classes.values())
    got = pipeline.drop_near_duplicates(spark, corpus, "")
    assert Counter(r["doc_id"] for r in got.collect()) == want and got.columns == COLUMNS
    assert not plain(got) - Counter(rows)
    assert pipeline.drop_near_duplicates(spark, empty, "").count() == 0


def test_secrets_stage(spark, corpus, empty):  # noqa: F811
    want = Counter()
    for r in corpus.select(*COLUMNS).collect():
        spans, out, at = [], [], 0
        for rank, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, r["text"] or "", re.A):
                if not (rule.group and rule.least) or len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), rank, m.end()))
        for a, _, b in sorted(spans):
            if a >= at:
                out += [r["text"][at:a], "[SECRET]"]
            at = max(at, b)
        text = None if r["text"] is None else "".join(out) + r["text"][at:]
        want[(r["doc_id"], text, r["lang"], r["source"], len(text) if spans else r["n_chars"])] += 1
    assert plain(pipeline.mask_secrets(spark, corpus, "")) == want
    assert pipeline.mask_secrets(spark, empty, "").count() == 0


def test_mixing_stage(spark, corpus, empty):  # noqa: F811
    rows = [tuple(r) for r in corpus.select(*COLUMNS).collect()]
    got, size = plain(pipeline.mix_sources(spark, corpus, "")), lambda t: len(WORD.findall(t or ""))
    many = Counter(rows)
    assert all(got[r] <= 3 * many[r] for r in got) and not set(got) - set(many)
    sizes, took, biggest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
        biggest[r[3]] = max(biggest[r[3]], size(r[1]))
    for r, n in got.items():
        took[r[3]] += n * size(r[1])
    want = brute_targets(dict(sizes))
    assert all(abs(took[s] - want[s]) <= 2 * biggest[s] + 1e-6 for s in want)
    assert sum(took.values()) == sum(r["taken"] for r in mixing.mix(corpus).collect())
    assert pipeline.mix_sources(spark, empty, "").count() == 0


def test_encoding_stage(spark, corpus, empty):  # noqa: F811
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"] or "", add_bos=True, add_eos=True))) for r in corpus.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in pipeline.encode_pieces(spark, corpus, "").collect()) == want
    assert pipeline.encode_pieces(spark, empty, "").count() == 0


def test_mixing_stage_of_a_hot_copy(spark):
    """Equal rows, more than a run of them, share their times; none is lost."""
    rows = [(None, "a b c", "en", None, 5)] * 12000 + [(None, "d e f", "en", None, 5)] * 7 + [(1, "x y", "en", "s", 3)] * 3 + [(2, None, None, "t", None)] * 2
    hot = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want, got = Counter(), Counter()
    for r in mixing.mix(hot).collect():
        want[r["doc_id"]] += r["times"]
    for r in pipeline.mix_sources(spark, hot, "").collect():
        assert tuple(r) in set(rows)
        got[r["doc_id"]] += 1
    assert got == +want and got[None] > 10_000
