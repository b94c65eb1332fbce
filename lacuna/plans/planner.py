"""From a request over incomplete tables to a plan of completion steps, and its run."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.catalog import Path, SchemaGraph
from lacuna.operators import aqp, completion, relational
from lacuna.operators.removal import Removal, incomplete
from lacuna.operators.tuple_factors import add_tf
from lacuna.sources.scratch import stored
from lacuna.sources.tables import cached_result


class Selection(Enum):
    NONE = "none"
    ARTIFICIAL_BIAS = "artificial bias"
    ARTIFICIAL_BIAS_MAE = "artificial bias, mae"
    UNIFORM_MAE = "uniform mae"
    COMBINED = "combined"


class Union(Enum):
    COMBINE = "combine"
    SCALE_UP = "scale up"


@dataclass
class Scenario:
    """Tables, which are complete, and their attributes to be modelled. Frames hold what remains; tuple factors are columns."""

    graph: SchemaGraph
    frames: dict[str, DataFrame]
    attributes: dict[str, list[str]]
    seed: int = 0
    support: int = 20
    evidence: int = 2
    #: For tables whose synthesized rows existing ones may replace: the numbers by which they are near.
    replace: dict[str, list[str]] = field(default_factory=dict)
    #: Tells the frames apart from those of other scenarios whose results are stored in the same folder.
    name: str = ""

    def with_tuple_factors(self, truth: dict[str, DataFrame]) -> Scenario:
        """Tuple factors counted on other (complete) frames, where a parent doesn't have one yet."""
        frames = dict(self.frames)
        for r in self.graph.relationships:
            if r.parent in frames and r.child in truth and r.tf not in frames[r.parent].columns:
                frames[r.parent] = add_tf(frames[r.parent], truth[r.child], r)
        return replace(self, frames=frames)


@dataclass
class Plan:
    """One or several branches of steps, with the way in which they are united."""

    branches: list[Path]
    union: Union = Union.COMBINE
    notes: list[str] = field(default_factory=list)
    replaced: frozenset[str] = frozenset()
    requested: frozenset[str] = frozenset()

    def explain(self) -> str:
        lines = []
        for i, p in enumerate(self.branches):
            lines.append(f"branch {i}: load {p.start}")
            for r, t in p.steps:
                way = "1:n" if t == r.child else "n:1"
                lines.append(f"  complete {way} {r.name} -> {t}" + (f", then existing {t} in place of synthesized ones" if way == "n:1" and t in self.replaced else ""))
            lines.append(f"  project {', '.join(sorted(p.requested))}; weights over {', '.join(r.tf for r in p.fan_out()) or 'nothing'}")
        return "\n".join([*lines, f"union: {self.union.value}" if len(self.branches) > 1 else "single branch"])


def candidates(graph: SchemaGraph, requested: set[str], fixed: set[str] | None = None) -> list[Path]:
    """Paths from complete tables; fixed: only those over exactly these tables and the requested ones."""
    found = graph.paths(requested)
    return [p for p in found if fixed is None or set(p.tables) == fixed | requested]


def plan(graph: SchemaGraph, requested: set[str], fixed: set[str] | None = None, union: Union = Union.COMBINE, score=None) -> Plan:
    """score: a number for a path, larger is better; if all are below 0 the plan is empty and the baseline is to be used."""
    found = candidates(graph, requested, fixed)
    if not found:
        raise ValueError(f"no complete table reaches {sorted(requested)}")
    if score is not None:
        ranked = sorted(((score(p), i) for i, p in enumerate(found)), key=lambda x: (-x[0], x[1]))
        if ranked[0][0] < 0:
            return Plan([], union, ["all candidates are worse than the baseline"], requested=frozenset(requested))
        found = [found[i] for _, i in ranked]
    best = found[0]
    if best.incoming:  # one branch for each last relationship
        seen, branches = set(), []
        for p in found:
            if p.incoming and p.steps[-1][0] not in seen:
                seen.add(p.steps[-1][0])
                branches.append(p)
        return Plan(branches, union)
    return Plan([best], union)


def with_replacement(p: Plan, s: Scenario) -> Plan:
    """The plan, with the replacements that the scenario asks for said in its text."""
    return replace(p, replaced=frozenset(t for t, f in s.replace.items() if f))


def pruned(s: Scenario, columns: list[str]) -> Scenario:
    """The scenario whose frames keep these columns, keys, links, tuple factors, and what models and replacement need."""
    frames = {}
    for t, df in s.frames.items():
        links = s.graph.touching(t)
        keep = {s.graph.tables[t].key, relational.WEIGHT, *columns, *s.attributes.get(t, []), *s.replace.get(t, [])}
        keep |= {r.fk for r in links if r.child == t} | {r.tf for r in links if r.parent == t}
        frames[t] = df.select(*[c for c in df.columns if c in keep])
    return replace(s, frames=frames)


def run_path(s: Scenario, path: Path, columns: list[str] | None = None) -> DataFrame:
    """The completed join along a path, before projection; with all columns, or those that `columns` needs."""
    if columns is not None:
        s = pruned(s, columns)
    df = relational.weighted(s.frames[path.start])
    known = list(s.attributes.get(path.start, []))
    for r, new in path.steps:
        evidence = known[-s.evidence :] if s.evidence else []
        key, columns = s.graph.tables[new].key, s.attributes.get(new, [])
        if new == r.child:
            df = completion.join_1n(df, s.frames[new], r, df, key, columns, evidence, s.seed, s.support)
        else:
            child_key = s.graph.tables[r.child].key
            df = completion.join_n1(df, s.frames[new], r, child_key, columns, evidence, s.seed, s.support)
            if s.replace.get(new):
                df = completion.replace_parents(df, s.frames[new], r, child_key, s.replace[new])
        df = df.drop(completion.SYNTHETIC)
        known += columns
    return df


def execute(s: Scenario, p: Plan, columns: list[str]) -> DataFrame:
    """The completed, weighted rows of the requested tables; of an empty plan what the incomplete tables hold."""
    if not p.branches:
        return relational.project(baseline(s, set(p.requested)), columns)
    parts = []
    for path in p.branches:
        done = run_path(s, path, columns)
        last = path.steps[-1][0].tf if path.steps else None
        keep = [*columns, *([last] if last and last in done.columns and last not in columns else [])]
        parts.append((completion.project_requested(done, path, keep), last))
    if len(parts) == 1:
        return parts[0][0].select(*columns, relational.WEIGHT)
    united = (relational.union_combine if p.union is Union.COMBINE else relational.union_scale_up)(parts)
    return united.select(*columns, relational.WEIGHT)


def complete(s: Scenario, requested: set[str], columns: list[str], **how) -> DataFrame:
    """Plan and run; a table that is complete is returned as it is."""
    if len(requested) == 1 and requested <= s.graph.complete:
        return relational.project(s.frames[next(iter(requested))], columns)
    return execute(s, plan(s.graph, requested, **how), columns)


def baseline(s: Scenario, requested: set[str], path: Path | None = None) -> DataFrame:
    """The requested join over what remains; with a path, only rows that its relationships connect."""
    start = next(t for t in s.graph.topological() if t in requested)
    df = relational.join_tables(s.graph, s.frames, s.graph.between(requested), start)
    return relational.connected_on_path(df, s.graph.relationships, set(path.tables)) if path else df


def ground_truth(graph: SchemaGraph, truth: dict[str, DataFrame], requested: set[str], tables: set[str] | None = None) -> DataFrame:
    """The requested join over complete tables; with tables, only rows that the relationships among them connect."""
    start = next(t for t in graph.topological() if t in requested)
    df = relational.join_tables(graph, truth, graph.between(requested), start)
    return relational.connected_on_path(df, graph.relationships, tables) if tables else df


def validation(s: Scenario, removal: Removal) -> Scenario:
    """A more incomplete scenario: the removal is done again on what remains, which counts as the truth."""
    known = s.with_tuple_factors(s.frames)
    _, frames = incomplete(s.graph, known.frames, [removal], list(s.frames), s.seed + 1)
    return replace(known, frames=frames)


def scores(s: Scenario, more: Scenario, paths: list[Path], requested: set[str], attribute: str, values: list | None = None, key: str | None = None) -> list[tuple[float, float]]:
    """Each path's bias reduction and mean absolute error (by key, where one is given) in the validation scenario."""
    keep, by_key = [attribute, *([key] if key and key != attribute else [])], key and not values
    mean = lambda df, name: aqp.mean_or_share(df, attribute, values).withColumnRenamed("value", name)
    true, base = (baseline(x, requested).select(*keep) for x in (s, more))
    true = stored(true, "score") if by_key else true
    known, out = stored(mean(base, "b").crossJoin(mean(true, "t")), "score-means"), []  # one row, for all paths
    for path in paths:
        done = completion.project_requested(run_path(more, path, keep), path, keep)
        done = stored(done, "score") if by_key else done
        row = mean(done, "p").crossJoin(known).select(aqp.bias_reduction(F.col("p"), F.col("b"), F.col("t")).alias("r"), F.abs(F.col("p") - F.col("t")).alias("e")).first()
        error = aqp.mean_absolute_error(done, true, key, attribute).first()["mae"] if by_key else row["e"]
        out.append((float(row["r"]), float(error if error is not None else row["e"])))
    return out


def score(s: Scenario, more: Scenario, path: Path, attribute: str, values: list | None = None, key: str | None = None) -> tuple[float, float]:
    """scores() of one path."""
    return scores(s, more, [path], set(path.requested), attribute, values, key)[0]


def plans_selected(s: Scenario, requested: set[str], strategies: list[Selection], removal: Removal, attribute: str, values: list | None = None, union: Union = Union.COMBINE, key: str | None = None) -> list[Plan]:
    """For each strategy a plan: each candidate path is run in a validation scenario, whose removal is the suspected one
    (for UNIFORM_MAE a uniform one); the best makes the plan. An empty plan says that the baseline is better than all.
    Strategies of the same removal share the validation scenario and its runs."""
    found, numbers, out = candidates(s.graph, requested), {}, []
    for strategy in strategies:
        if strategy is Selection.NONE or len(found) < 2 and strategy is not Selection.ARTIFICIAL_BIAS:
            out.append(plan(s.graph, requested, union=union))
            continue
        uniform = strategy is Selection.UNIFORM_MAE
        if uniform not in numbers:
            more = validation(s, replace(removal, kind="uniform", attribute=None) if uniform else removal)
            numbers[uniform] = scores(s, more, found, requested, attribute, values, key)
        best = select(strategy, [r for r, _ in numbers[uniform]], [e for _, e in numbers[uniform]])
        if best is None:
            out.append(Plan([], union, ["all candidates are worse than the baseline"], requested=frozenset(requested)))
        else:
            out.append(plan(s.graph, requested, union=union, score=lambda p, best=best: 1.0 if p == found[best] else 0.0))
    return out


def plan_selected(s: Scenario, requested: set[str], strategy: Selection, removal: Removal, attribute: str, values: list | None = None, union: Union = Union.COMBINE, key: str | None = None) -> Plan:
    """plans_selected() of one strategy."""
    return plans_selected(s, requested, [strategy], removal, attribute, values, union, key)[0]


@dataclass
class Run:
    """What a plan's run gave: its rows (stored), seconds, and for each branch the rows and the sum of weights."""

    rows: DataFrame
    seconds: float
    stats: list[dict]


def execute_timed(s: Scenario, p: Plan, columns: list[str], folder: str | None = None) -> Run:
    """Reads the result where the same plan over the same columns, for a scenario of the same name, attributes and
    parameters, has been run into the folder; else runs and writes it. Scenarios of one folder have different names."""
    begin = time.time()
    make = lambda: execute(s, p, columns)
    spark = next(iter(s.frames.values())).sparkSession
    text = f"{p.explain()}|{columns}|{s.name}|{sorted(s.attributes.items())}|{sorted(s.replace.items())}|{s.seed}|{s.support}|{s.evidence}"
    rows = cached_result(spark, text, folder, make) if folder else stored(make(), "result")
    whole = rows.agg(F.count("*").alias("rows"), F.sum(relational.WEIGHT).alias("weight")).first().asDict()
    return Run(rows, time.time() - begin, [whole | {"branches": len(p.branches)}])


def combined_scores(bias: list[float], mae: list[float]) -> list[float]:
    """Bias reduction and error, each scaled to [0, 1], added up."""
    scaled = lambda x: [(v - min(x)) / (max(x) - min(x)) if max(x) > min(x) else 1.0 for v in x]
    return [a + b for a, b in zip(scaled(bias), scaled([-m for m in mae]))]


def select(strategy: Selection, bias: list[float], mae: list[float]) -> int | None:
    """The best candidate's place; None: the baseline is better."""
    if strategy is Selection.NONE:
        return 0
    scores = {Selection.ARTIFICIAL_BIAS: bias, Selection.ARTIFICIAL_BIAS_MAE: [-m for m in mae], Selection.UNIFORM_MAE: [-m for m in mae], Selection.COMBINED: combined_scores(bias, mae)}[strategy]
    if strategy is Selection.ARTIFICIAL_BIAS and max(scores) < 0:
        return None
    return max(range(len(scores)), key=lambda i: (scores[i], -i))


def step_stats(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """The same rows, observed: number of rows and sum of weights, once an action has run."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), F.sum(relational.WEIGHT).alias("weight")), o
