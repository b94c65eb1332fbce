"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived (an AND of ORs of the trigrams of its mandatory literal
strings, folded to lower case). The index holds postings (trigram, document key) for the trigrams that some query
asks for. Candidates are the keys whose postings, intersected, answer a rule's query; each candidate is verified by
the regex on the whole text. A rule that has no mandatory trigram scans every text.

A key is a 64-bit hash of row and text: rows that share one share candidates, which can only add verifications.

Defined results: a null text counts as empty; a null doc_id is kept; repeated rows are each returned; an empty table
gives an empty result; further columns are not read. At one start, spans are in the order of the rules.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

parser = re._parser  # the parse tree of a regex


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The kinds of the contract. A run that is too short can't be matched later inside itself, so that the least length
#: of access and hex can stand in the pattern; assign is matched first and measured then.
BASE = [
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
#: Further kinds, in publicly documented formats.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
]
RULES = BASE + MORE
#: A literal with more variants than this ends there.
VARIANTS = 64


def literals(pattern: str) -> list[set[str]]:
    """Sets of lower-case strings; every match holds a string of each set."""
    done: list[set[str]] = []

    def chars(items) -> set[str] | None:
        found = set()
        for op, arg in items:
            if op is parser.LITERAL:
                found.add(chr(arg).lower())
            elif op is parser.RANGE and arg[1] - arg[0] < 8:
                found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None

    def close(run: set[str]) -> set[str]:
        if run != {""}:
            done.append(run)
        return {""}

    def joined(run: set[str], more: set[str]) -> set[str]:
        both = {a + b for a, b in itertools.product(run, more)}
        return both if len(both) <= VARIANTS else joined(close(run), more)

    def whole(tree) -> set[str] | None:
        """All strings of a tree, if they are few."""
        run = {""}
        for op, arg in tree:
            part: set[str] | None
            if op is parser.LITERAL:
                part = {chr(arg).lower()}
            elif op is parser.IN:
                part = chars(arg)
            elif op is parser.SUBPATTERN:
                part = whole(arg[3])
            elif op is parser.BRANCH:
                each = [whole(x) for x in arg[1]]
                part = None if None in each else set().union(*each)
            elif op is parser.MAX_REPEAT and arg[1] <= 2:
                one = whole(arg[2])
                part = one and set().union(*({"".join(x) for x in itertools.product(one, repeat=n)} for n in range(arg[0], int(arg[1]) + 1)))
            else:
                part = None
            if part is None or len(run) * len(part) > VARIANTS:
                return None
            run = {a + b for a, b in itertools.product(run, part)}
        return run

    def walk(tree) -> None:
        run = {""}
        for node in tree:
            part = whole([node])
            if part is not None:
                run = joined(run, part)
            else:
                run = close(run)
                op, arg = node
                if op is parser.SUBPATTERN:
                    walk(arg[3])
                elif op is parser.MAX_REPEAT and arg[0] >= 1:
                    walk(arg[2])
        close(run)

    walk(parser.parse(pattern))
    return done


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of trigram sets; empty: any text may match."""
    found = []
    for strings in literals(pattern):
        if min(map(len, strings)) >= 3:
            options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # A set that contains another one's trigrams is implied by it.
            found.append([o for o in sorted(options, key=sorted) if not any(p < o for p in options)])
    return found


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and key."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    return docs.withColumn("key", F.xxhash64("text", "doc_id"))


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, key) of keyed documents; gram is a place in grams."""
    folded = docs.select("key", F.lower(F.replace(F.col("text"), F.lit("K"), F.lit("k"))).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    return folded.select(F.explode(has).alias("gram"), "key")


def candidates(postings: DataFrame, rules: list[Rule], grams: list[str]) -> DataFrame:
    """key and bits (of the places of rules whose query the key's postings answer); keys without a bit are left out."""
    place = {g: i for i, g in enumerate(grams)}
    words = -(-len(grams) // 62)
    masks = [
        F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in range(words)
    ]
    met = postings.withColumn("gram", F.col("gram").cast("int")).groupBy("key").agg(*masks)

    def holds(grams_of: frozenset[str]) -> Column:
        need = [sum(1 << (place[g] % 62) for g in grams_of if place[g] // 62 == w) for w in range(words)]
        tests = [(F.col(f"m{w}").bitwiseAND(F.lit(n)) == F.lit(n)) for w, n in enumerate(need) if n]
        return _all(tests)

    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            answers = _all([_any([holds(o) for o in options]) for options in query])
            bits = bits + F.when(answers, F.lit(1 << i)).otherwise(F.lit(0))
    return met.select("key", bits.alias("bits")).filter("bits != 0")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, text and found: an array of (start, rank of the rule, end) in order of start, then rank."""
    docs = keyed(docs)
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for options in q for o in options for g in o})
    if grams:
        docs = docs.join(candidates(index(docs, grams), rules, grams), "key", "left")
    else:
        docs = docs.withColumn("bits", F.lit(0).cast("long"))
    docs = docs.withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    none = F.array().cast("array<string>")
    for i, (rule, q) in enumerate(zip(rules, queries)):
        ask = F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 if q else F.lit(True)
        docs = docs.withColumn(f"all{i}", F.when(ask, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).otherwise(none))
    for i, rule in enumerate(rules):
        docs = docs.withColumn(f"parts{i}", F.when(F.size(f"all{i}") > 0, _parts(i, rule)))
    found = F.concat(*(_spans(i) for i in range(len(rules))))
    return docs.select("doc_id", "text", F.array_sort(found).alias("found"))


def _parts(i: int, rule: Rule) -> Column:
    """For each match of a rule: the length of what lies before it (after the match before), its own, and whether it is long enough."""
    between = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(f"all{i}"))
    if not (rule.group and rule.least):
        return F.zip_with(between, f"all{i}", lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), F.lit(True).alias("fits")))
    parts = F.zip_with(between, f"all{i}", lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    return F.zip_with(parts, value, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (F.length(v) >= rule.least).alias("fits")))


def _spans(i: int) -> Column:
    """The spans of a rule's matches: places follow from the lengths of the matches and of what lies between them."""
    at = running(F.transform(f"parts{i}", lambda x: x["gap"] + x["size"]), lambda a, x: a + x)
    span = lambda x, a: F.struct((a + x["gap"]).alias("start"), F.lit(i).alias("rank"), (a + x["gap"] + x["size"]).alias("end"))
    found = F.array_compact(F.zip_with(f"parts{i}", at, lambda x, a: F.when(x["fits"], span(x, a))))
    return F.coalesce(found, F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))


#: Elements that one step of a running fold takes: arrays that grow by one element are copied, so that they stay short.
STEP = 128


def let(x: Column, use) -> Column:
    """use(x), with x evaluated once, however often it stands in there."""
    return F.element_at(F.transform(F.array(x), use), 1)


def chunks(xs: Column) -> Column:
    """The array in pieces of STEP elements; null where it is null or empty."""
    return let(xs, lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda c: F.slice(v, c * STEP + 1, F.lit(STEP)))))


def running(xs: Column, fold) -> Column:
    """For each element the fold of 0 and all elements before it (numbers; an associative fold with 0 as its start)."""
    zero = F.lit(0).cast("long")
    grow = lambda a, x: F.concat(a, F.array(fold(F.element_at(a, -1), x)))
    within = lambda c, b: F.slice(F.aggregate(c, F.array(b), grow), F.lit(1), F.size(c))

    def over(v: Column) -> Column:
        before = F.aggregate(F.transform(v, lambda c: F.aggregate(c, zero, fold)), F.array(zero), grow)
        return F.flatten(F.zip_with(v, F.slice(before, F.lit(1), F.size(v)), within))

    return let(chunks(xs), over)


def joined_spans(found: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    text = lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(found, text), ",")


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["rank"] == k)).cast("long")
    return scan(documents).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(F.filter(found, lambda x: x["rank"] < len(BASE)), RULES), 256).alias("base_sha256"),
        joined_spans(found, RULES).alias("spans"),
    )


def masked(docs: DataFrame, rules: list[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """doc_id, text with each stretch of overlapping spans replaced by `mask`, and n_spans. For joining back by row, use mask_documents."""
    return scan(docs, rules).select("doc_id", _mask(mask).alias("text"), F.size("found").alias("n_spans"))


def _mask(mask: str) -> Column:
    found = F.col("found")
    # The largest end before each span: where that lies beyond its start, the span belongs to the stretch before.
    last = running(F.transform(found, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    gaps = F.zip_with(found, last, lambda x, m: F.struct(m.alias("from"), x["start"].alias("to")))
    gaps = F.filter(gaps, lambda g: g["to"] >= g["from"])
    cut = lambda text, at, n: F.substring(text, (at + 1).cast("int"), n.cast("int"))

    def piece(c: Column) -> Column:  # of the text, cut out once for all its gaps
        base = c[0]["from"]
        own = F.array(cut(F.col("text"), base, F.element_at(c, -1)["to"] - base))
        return F.array_join(F.flatten(F.transform(own, lambda t: F.transform(c, lambda g: F.concat(cut(t, g["from"] - base, g["to"] - g["from"]), F.lit(mask))))), "")

    rest = F.array_max(F.transform(found, lambda x: x["end"]))
    whole = F.concat(F.array_join(F.transform(chunks(gaps), piece), ""), cut(F.col("text"), rest, F.length("text") - rest))
    return F.when(F.size(found) > 0, whole).otherwise(F.col("text"))


def mask_documents(documents: DataFrame, rules: list[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with their secrets masked; n_chars follows the text. A null text stays null."""
    packed = documents.select(F.struct("doc_id", "text", "lang", "source", "n_chars").alias("doc_id"), "text")
    out = scan(packed, rules).select(F.col("doc_id").alias("d"), _mask(mask).alias("new"), (F.size("found") > 0).alias("hit"))
    return out.select(
        "d.doc_id",
        F.when(F.col("d.text").isNull(), F.lit(None)).otherwise(F.col("new")).alias("text"),
        "d.lang",
        "d.source",
        F.when(F.col("hit"), F.length("new").cast("long")).otherwise(F.col("d.n_chars")).alias("n_chars"),
    )


def _sql() -> str:
    per = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        fits = f"length(vs[k]) >= {r.least}" if r.group and r.least else "true"
        value = f"regexp_extract_all(t, '{p}', {r.group if r.least else 0})"
        per.append(
            f"""SELECT r, {i} AS rank, '{r.kind}' AS kind, unnest([struct_pack(s := list_sum(list_transform(bs[1:k], lambda x: length(x))) +
              coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0), n := length(ms[k]), ok := {fits}) for k in range(1, len(ms) + 1)]) AS x
            FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, {value} AS vs, string_split_regex(t, '{p}') AS bs FROM d) WHERE len(ms) > 0"""
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(per)}),
    s AS (SELECT r, rank, CAST(x.s AS BIGINT) AS a, kind || ':' || CAST(CAST(x.s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(x.s + x.n AS BIGINT) AS VARCHAR) AS w FROM m WHERE x.ok),
    g AS (SELECT r, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
      coalesce(string_agg(w, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}), '') AS base, string_agg(w, ',' ORDER BY a, rank) AS spans FROM s GROUP BY r)
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


SQL = _sql()
