"""Which models a scenario needs: one for each step of a completion path, merged where one answers for another. Plain Python."""

from __future__ import annotations

from dataclasses import dataclass, replace

from lacuna.catalog import Path, Relationship, SchemaGraph


@dataclass(frozen=True)
class Setup:
    """A model of the columns that a step adds, given the evidence columns; for 1:n steps also of the tuple factor."""

    relationship: Relationship
    down: bool
    evidence: tuple[str, ...]
    targets: tuple[str, ...]
    sets: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        way = "down" if self.down else "up"
        return f"{self.relationship.name}.{way}({','.join(self.evidence)}->{','.join(self.targets)})" + (f"+{','.join(self.sets)}" if self.sets else "")


#: Presets: rows that a context needs, columns that a draw is conditioned on, and whether sets of children are evidence.
PRESETS = {
    "counts": dict(support=20, most_parents=2, sets=False),
    "counts-wide": dict(support=20, most_parents=4, sets=False),
    "counts-small": dict(support=5, most_parents=1, sets=False),
    "sets": dict(support=20, most_parents=2, sets=True),
    "test": dict(support=1, most_parents=1, sets=False),
}


def of_path(path: Path, attributes: dict[str, list[str]]) -> list[Setup]:
    """The setups of a path's steps, each with all attributes that are known before it."""
    known, out = list(attributes.get(path.start, [])), []
    for r, new in path.steps:
        down = new == r.child
        targets = tuple(attributes.get(new, []))
        out.append(Setup(r, down, tuple(known), ((r.tf, *targets) if down else targets)))
        known += targets
    return out


def of_tables(graph: SchemaGraph, attributes: dict[str, list[str]], requested: list[set[str]]) -> list[Setup]:
    """Setups of all paths to the requested joins, each once."""
    return list(dict.fromkeys(x for tables in requested for p in graph.paths(tables) for x in of_path(p, attributes)))


def of_all_joins(graph: SchemaGraph, attributes: dict[str, list[str]], most: int = 3) -> list[Setup]:
    """Setups for all connected joins of up to `most` tables."""
    joins, grown = {frozenset({t}) for t in graph.tables}, {frozenset({t}) for t in graph.tables}
    for _ in range(most - 1):
        grown = {have | {r.child, r.parent} for have in grown for r in graph.relationships if (r.child in have) != (r.parent in have)}
        joins |= grown
    return of_tables(graph, attributes, [set(j) for j in sorted(joins, key=sorted)])


def reduced(path: Path, evidence: int) -> Path:
    """The path without the beginning that no step's evidence of so many tables reaches back to."""
    if len(path.steps) <= evidence:
        return path
    cut = len(path.steps) - evidence
    return Path(path.steps[cut - 1][1], path.steps[cut:], path.requested)


def merged(setups: list[Setup]) -> list[Setup]:
    """Without setups that another one of the same relationship and direction answers for: all its evidence and targets."""
    covers = lambda a, b: a != b and a.relationship == b.relationship and a.down == b.down and set(b.evidence) <= set(a.evidence) and set(b.targets) <= set(a.targets) and set(b.sets) <= set(a.sets)
    return [x for x in setups if not any(covers(y, x) for y in setups)]


def with_sets(setup: Setup, graph: SchemaGraph) -> Setup:
    """Sets of children as further evidence: those of the step's parent, other than the ones that it completes."""
    others = [r.tf for r in graph.relationships if r.parent == setup.relationship.parent and r != setup.relationship]
    return replace(setup, sets=tuple(sorted(others)))


def expanded(setup: Setup, hierarchy: dict[str, tuple[str, ...]]) -> Setup:
    """Evidence columns replaced by the finer columns that they stand for."""
    return replace(setup, evidence=tuple(c for e in setup.evidence for c in hierarchy.get(e, (e,))))


def chosen(setups: list[Setup], step: Setup) -> Setup | None:
    """Of the learned setups the one with the most evidence among those that answer for a step."""
    fits = [x for x in setups if x.relationship == step.relationship and x.down == step.down and set(x.evidence) <= set(step.evidence) and set(step.targets) <= set(x.targets)]
    return max(fits, key=lambda x: (len(x.evidence), x.name), default=None)
