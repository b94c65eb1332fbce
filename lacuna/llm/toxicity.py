"""Toxicity by a weighted finite-state pattern grammar.

Words are classed: insult, threat, intent, target, negation, report, the literal words of patterns, and other. Five
transducers read a clause. Two of them match patterns of classes, of one word or more ("piece of" an insult; an intent
and a threat; a threat and a target), and emit a match with its weight where a pattern ends, whatever else it overlaps:
insults and threats. Three are contexts: one remembers a target; one counts down the few words over which a negation
holds; one remembers reported speech. Their composition has the product of their states and is built state by state as
clauses reach it. A match goes to a register by its kind and by the composed state (plain, aimed, negated, reported).
A clause's matches count only with the registers of its whole path: where a target stands anywhere in the clause, its
plain matches become aimed at the clause's end.

A document's score is the logistic of the registers' sums over its clauses, relative to what a document of its kind
would need. Weights of words, further insults of one word or two (by smoothed log odds) and the registers' coefficients
are learned from labelled documents, of which at most `most` (a hash sample, by their doc_id) are read; everything else
is scored by every document. Neither lang, source, doc_id nor labels are inputs of a score, and rows that are held out
are never learned from.

Defined results: a null text counts as empty; an empty text scores as one without matches; null doc_id and repeated
rows are kept row by row (a null doc_id isn't held out and has no label); a doc_id with several labels is toxic if
one of them is; without any labels the seeds' weights hold; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, stored, text_or_empty, words_of

#: Labelled documents that are learned from, at most.
MOST = 20_000
#: A word becomes an insult by learning if so large a share of the toxic documents have it, with such log odds.
SHARE, ODDS = 0.02, 3.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
REGISTERS = ("plain", "aimed", "negated", "reported")
PLAIN, AIMED, NEGATED, REPORTED = range(4)
#: Seeds of the classes.
SEEDS = {
    INSULT: "idiot moron stupid trash garbage scum loser pathetic worthless disgusting clown imbecile vermin filth dumb ugly idiote imbécile salaud connard ordure dummkopf trottel abschaum widerlich estúpido basura escoria".split(),
    THREAT: "kill murder hurt beat destroy shoot stab töten umbringen tuer matar".split(),
    TARGET: "you your yourself he she they them him her their toi vous tu ihr euch dich du tú usted ellos".split(),
    NEGATION: "not no never nobody isn't aren't don't won't without nicht kein keine nie pas jamais sans nunca sin".split(),
    REPORT: "said says wrote writes called quoted reported according claimed alleged sagte schrieb zitierte dit écrit dijo escribió".split(),
    INTENT: "will shall gonna must should i'll we'll werde werden wird vais va voy vamos".split(),
}
#: Patterns of classes and literal words, with the weight of a match; a match also has the weight of its last weighted word.
PATTERNS = {
    INSULT: [((INSULT,), 1.0), (("piece", "of", INSULT), 0.5), (("bunch", "of", INSULT), 0.5), ((TARGET, INSULT), 0.5), (("waste", "of", "space"), 1.0), (("go", "to", "hell"), 1.0), (("shut", "up"), 0.5)],
    THREAT: [((THREAT,), 1.0), ((INTENT, THREAT), 0.5), ((THREAT, TARGET), 0.5), ((INTENT, "be", "sorry"), 0.5), (("going", "to", THREAT), 0.5), (("drop", "dead"), 1.0), (("hope", TARGET, "die"), 1.0)],
}
NEGATION_SPAN = 3
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…"
ENDS = ".!?;:"


class Transducer:
    """A deterministic transducer over classes: states are numbers, 0 is the start; out says what is emitted on entering a state."""

    def step(self, state: int, c: int) -> int:
        raise NotImplementedError

    def out(self, state: int) -> list[float]:
        return []


class Remembers(Transducer):
    """State 1 from the first word of a class on."""

    def __init__(self, of: int):
        self.of = of

    def step(self, state: int, c: int) -> int:
        return 1 if c == self.of else state


class Lasts(Transducer):
    """After a word of a class, so many words above state 0."""

    def __init__(self, of: int, span: int):
        self.of, self.span = of, span

    def step(self, state: int, c: int) -> int:
        return self.span if c == self.of else max(0, state - 1)


class Matches(Transducer):
    """States are beginnings of patterns: the longest that the words read so far end with. Emits the weight of each pattern that ends."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], float]]):
        self.patterns = patterns
        self.begins = sorted({p[:k] for p, _ in patterns for k in range(len(p) + 1)}, key=lambda x: (len(x), x))
        self.at = {x: i for i, x in enumerate(self.begins)}
        self.emits = [[w for p, w in patterns if x[len(x) - len(p) :] == p] for x in self.begins]

    def step(self, state: int, c: int) -> int:
        read = (*self.begins[state], c)
        return next(self.at[read[k:]] for k in range(len(read) + 1) if read[k:] in self.at)

    def out(self, state: int) -> list[float]:
        return self.emits[state]

    @property
    def last(self) -> set[int]:
        return {p[-1] for p, _ in self.patterns}


class Composed:
    """The product of transducers; its arcs are built when they are first taken."""

    def __init__(self, insults: Matches, threats: Matches):
        self.parts = (insults, threats, Remembers(TARGET), Lasts(NEGATION, NEGATION_SPAN), Remembers(REPORT))
        self.states, self.at, self.arcs = [(0,) * 5], {(0,) * 5: 0}, {}

    def arc(self, state: int, c: int) -> tuple[int, list[tuple[int, float]]]:
        """The next state, and for each match its register (of 2 * 4) and weight."""
        if (state, c) not in self.arcs:
            now = self.states[state]
            then = tuple(t.step(s, c) for t, s in zip(self.parts, now))
            _, _, target, negation, report = now
            context = REPORTED if report else NEGATED if negation else AIMED if target else PLAIN
            found = [(kind * 4 + context, w) for kind in (0, 1) for w in self.parts[kind].out(then[kind])]
            if then not in self.at:
                self.at[then] = len(self.states)
                self.states.append(then)
            self.arcs[state, c] = self.at[then], found
        return self.arcs[state, c]

    def clause(self, classes: list[int], weights: list[float]) -> list[float]:
        """Sums by register of one clause's matches."""
        out, state, last = [0.0] * 8, 0, 1.0
        for c, w in zip(classes, weights):
            last = w or last
            state, found = self.arc(state, c)
            for register, weight in found:
                out[register] += weight * last
        if self.states[state][2]:
            for kind in (0, 4):
                out[kind + AIMED] += out[kind + PLAIN]
                out[kind + PLAIN] = 0.0
        return out


FEATURES = 9


@dataclass
class Grammar:
    """Word classes with weights, patterns, and the coefficients: bias, then by feature."""

    words: dict[str, tuple[int, float]]
    patterns: dict[int, list[tuple[tuple[int, ...], float]]]
    beta: list[float] = field(default_factory=lambda: [-3.0, 3.0, 3.5, 1.0, 1.0, 3.0, 3.5, 1.0, 1.0, 1.0])

    def __post_init__(self):
        self._composed = None

    def __getstate__(self):
        return self.__dict__ | {"_composed": None}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def compiled(self) -> Composed:
        if self._composed is None:
            self._composed = Composed(Matches(self.patterns[INSULT]), Matches(self.patterns[THREAT]))
        return self._composed

    def class_of(self, word: str) -> int:
        """A word's class; a word without one becomes a literal, a class of its own."""
        return self.words.setdefault(word, (max(INTENT, *(c for c, _ in self.words.values())) + 1, 0.0))[0]

    def add(self, kind: int, pattern: tuple, weight: float) -> None:
        self.patterns[kind].append((tuple(x if isinstance(x, int) else self.class_of(x) for x in pattern), weight))
        self._composed = None

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text: log(1 + sum) of each register, and the largest clause."""
        words, offsets = words_of(texts)
        coded = words.dictionary_encode()
        ids = np.asarray(coded.indices)
        bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=EDGE).to_pylist()
        kinds = np.fromiter((self.words.get(w, (OTHER, 0.0))[0] for w in bare), np.int32, len(bare))
        weights = np.fromiter((self.words.get(w, (OTHER, 0.0))[1] for w in bare), float, len(bare))
        tails = pc.utf8_rtrim(coded.dictionary, characters="".join(set(EDGE) - set(ENDS))).to_pylist()
        ends = np.fromiter((w[-1:] in ENDS and w != "" for w in tails), bool, len(tails))
        kind, machine = kinds[ids], self.compiled()
        out = np.zeros((len(texts), FEATURES))
        # Clauses without a word that can end a pattern have no match.
        hits = np.flatnonzero(np.isin(kind, list(machine.parts[0].last | machine.parts[1].last)))
        if not len(hits):
            return out
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        # A clause ends with its text or at an end mark.
        last = ends[ids].copy()
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        clause_ends = np.flatnonzero(last)
        for c in np.unique(np.searchsorted(clause_ends, hits)):
            begin, end = (clause_ends[c - 1] + 1 if c else 0), clause_ends[c] + 1
            sums = machine.clause(kind[begin:end].tolist(), weights[ids[begin:end]].tolist())
            row = out[text[begin]]
            row[:8] += sums
            row[8] = max(row[8], sums[PLAIN] + sums[AIMED] + sums[4 + PLAIN] + sums[4 + AIMED])
        out[:, :8] = np.log1p(np.maximum(out[:, :8], 0))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.beta[0] + self.features(texts) @ np.array(self.beta[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def seeded() -> Grammar:
    g = Grammar({w: (c, 1.0 if c in (INSULT, THREAT) else 0.0) for c, words in SEEDS.items() for w in words}, {INSULT: [], THREAT: []})
    for kind, patterns in PATTERNS.items():
        for pattern, weight in patterns:
            g.add(kind, pattern, weight)
    return g


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """text and toxic of at most about `most` labelled documents that are not held out, each text once."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out())
    share = min(1.0, most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About `most` rows of two numbers: that's the bound of what is broadcast.
    got = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    return stored(got.groupBy(F.md5("text").alias("code")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")


def _term_counts(only: set[str] | None):
    """(term, n): in how many of the texts each word, and each two words in a row, stands; of all terms, or of those in `only`."""

    def run(batches):
        for batch in batches:
            for step in steps(batch):
                words, offsets = words_of(step.column("text"))
                coded = words.dictionary_encode()
                bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=EDGE).dictionary_encode()
                names = bare.dictionary.to_pylist()
                ids = np.asarray(bare.indices).astype(np.int64)[np.asarray(coded.indices)]
                text, n = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), len(names) + 1
                two = np.flatnonzero(text[1:] == text[:-1])
                terms = np.concatenate([ids, n + ids[two] * n + ids[two + 1]])
                distinct, code = np.unique(terms, return_inverse=True)
                once = np.unique(np.concatenate([text, text[two]]) * max(1, len(distinct)) + code)
                many = np.bincount(once % max(1, len(distinct)), minlength=len(distinct))
                written = [names[t] if t < n else f"{names[t // n - 1]} {names[t % n]}" for t in distinct.tolist()]
                take = [i for i, t in enumerate(written) if only is None or t in only]
                yield pa.RecordBatch.from_arrays([pa.array([written[i] for i in take], pa.string()), pa.array(many[take])], names=["term", "n"])

    return run


def _counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
    return rows.select("text").mapInArrow(_term_counts(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, rounds: int = 25) -> Grammar:
    """A grammar learned from the sample; only counts, terms over the thresholds and features come to the driver."""
    rows, grammar = sample(docs, labels, most), seeded()
    n_yes, n_no = (int(x or 0) for x in rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first())
    if not n_yes or not n_no:
        return grammar
    seeds = [w for c in (INSULT, THREAT) for w in SEEDS[c]]
    # No more terms than a text has words for every SHARE of the texts.
    often = _counted(rows.filter("toxic > 0"), None).filter((F.col("n") >= max(5, SHARE * n_yes)) | F.col("term").isin(seeds)).collect()
    yes = {r["term"]: r["n"] for r in often if r["term"].strip()} | {w: 0 for w in seeds if w not in {r["term"] for r in often}}
    no = {r["term"]: r["n"] for r in _counted(rows.filter("toxic <= 0"), set(yes)).collect()}
    odds = {t: math.log((n + 0.5) / (n_yes + 1)) - math.log((no.get(t, 0) + 0.5) / (n_no + 1)) for t, n in yes.items()}
    worth = lambda t: max(0.0, min(1.5, odds[t] / 5))
    for t in sorted(yes, key=lambda t: (t.count(" "), t)):
        kind = grammar.words.get(t, (None, 0.0))[0]
        if kind in (INSULT, THREAT):
            if yes[t] or no.get(t):
                grammar.words[t] = (kind, worth(t))
        elif odds[t] >= ODDS and " " not in t and kind is None:
            grammar.words[t] = (INSULT, worth(t))
        elif odds[t] >= ODDS and " " in t and not any(grammar.words.get(w, (None, 0.0))[0] in (INSULT, THREAT) for w in t.split(" ")):
            grammar.add(INSULT, tuple(t.split(" ")), worth(t))

    sent = rows.sparkSession.sparkContext.broadcast(grammar)

    def features(batches):
        for batch in batches:
            for step in steps(batch):
                x = sent.value.features(step.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(FEATURES)] + [step.column("toxic").cast(pa.float64())], names=[f"x{i}" for i in range(FEATURES)] + ["y"])

    # Documents with the same features are one row with a weight.
    table = rows.select("text", "toxic").mapInArrow(features, ", ".join(f"x{i} double" for i in range(FEATURES)) + ", y double").groupBy(*[f"x{i}" for i in range(FEATURES)]).agg(F.sum("y").alias("y"), F.count("*").alias("n")).toPandas()
    x = np.column_stack([np.ones(len(table)), table[[f"x{i}" for i in range(FEATURES)]].to_numpy()])
    y, n = table["y"].to_numpy(), table["n"].to_numpy(float)
    order = np.lexsort(x.T)
    x, y, n = x[order], y[order], n[order]
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((x.T * w) @ x + ridge, x.T @ (y - n * p) - ridge @ beta)
        beta = beta + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    grammar.beta = beta.tolist()
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    assert all(math.isfinite(b) for b in grammar.beta)

    def run(batches):
        for batch in batches:
            for step in steps(batch):
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(sent.value.score(step.column("text")))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels))
