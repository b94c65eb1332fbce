"""Schemas as graphs of primary and foreign keys, and walks over them. Plain Python on the driver."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from functools import cached_property

CAP = 10_000  # a string column with more distinct values isn't modelled


@dataclass(frozen=True)
class TableDef:
    name: str
    key: str
    columns: tuple[str, ...]
    ignored: tuple[str, ...] = ()
    sample_rate: float = 1.0


@dataclass(frozen=True)
class Relationship:
    """Foreign key: many child rows refer to one parent row."""

    child: str
    fk: str
    parent: str
    pk: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.fk}={self.parent}.{self.pk}"

    @property
    def tf(self) -> str:
        """The parent's column that says how many children it has; null: not known."""
        return f"tf_{self.child}_{self.fk}"

    def other(self, table: str) -> str:
        return self.parent if table == self.child else self.child


@dataclass(frozen=True)
class SchemaGraph:
    tables: dict[str, TableDef]
    relationships: tuple[Relationship, ...]
    complete: frozenset[str] = frozenset()

    def __post_init__(self):
        for r in self.relationships:
            for table, column in ((r.child, r.fk), (r.parent, r.pk)):
                if table not in self.tables or column not in (*self.tables[table].columns, self.tables[table].key):
                    raise ValueError(f"{r.name}: no column {table}.{column}")

    def with_complete(self, *tables: str) -> SchemaGraph:
        return replace(self, complete=frozenset(tables))

    def touching(self, table: str) -> list[Relationship]:
        return [r for r in self.relationships if table in (r.child, r.parent)]

    def between(self, tables: set[str]) -> list[Relationship]:
        return [r for r in self.relationships if {r.child, r.parent} <= tables]

    def order(self, relationships: list[Relationship], start: str) -> list[tuple[Relationship, str]]:
        """Relationships in an order in which each touches what came before; with the table that each adds."""
        have, left, out = {start}, list(relationships), []
        while left:
            r = next((r for r in left if (r.child in have) != (r.parent in have)), None)
            if r is None:
                raise ValueError("the relationships are not connected")
            left.remove(r)
            new = r.parent if r.child in have else r.child
            have.add(new)
            out.append((r, new))
        return out

    def paths(self, requested: set[str]) -> list[Path]:
        """One path from each complete table that can be reached without passing another, breadth first."""
        if requested <= self.complete:
            return [Path(next(iter(sorted(requested))), (), frozenset(requested))] if len(requested) == 1 else []
        inner = self.between(requested)
        found, queue, seen = [], deque([(frozenset(requested), ())]), {frozenset(requested)}
        while queue:
            have, steps = queue.popleft()
            for t in sorted(have & self.complete):
                order = self.order([*inner, *steps], t)
                found.append(Path(t, tuple(order), frozenset(requested)))
            if have & self.complete:
                continue
            for r in self.relationships:
                if (r.child in have) != (r.parent in have):
                    more = have | {r.child, r.parent}
                    if more not in seen:
                        seen.add(more)
                        queue.append((more, (*steps, r)))
        return found

    def topological(self) -> list[str]:
        """Tables in an order in which parents come before their children."""
        from graphlib import TopologicalSorter

        return list(TopologicalSorter({t: {r.parent for r in self.relationships if r.child == t and r.parent != t} for t in self.names}).static_order())

    def renamed(self, names: dict[str, str]) -> SchemaGraph:
        """A copy in which tables have other names."""
        new = lambda t: names.get(t, t)
        tables = {new(n): replace(t, name=new(n)) for n, t in self.tables.items()}
        links = tuple(replace(r, child=new(r.child), parent=new(r.parent)) for r in self.relationships)
        return SchemaGraph(tables, links, frozenset(map(new, self.complete)))

    @cached_property
    def names(self) -> list[str]:
        return sorted(self.tables)


@dataclass(frozen=True)
class Path:
    """A completion path: the complete table where it starts, then each relationship with the table it adds."""

    start: str
    steps: tuple[tuple[Relationship, str], ...]
    requested: frozenset[str] = field(default_factory=frozenset)

    @property
    def tables(self) -> list[str]:
        return [self.start, *(t for _, t in self.steps)]

    @property
    def incoming(self) -> bool:
        """Whether the last step's requested table is its parent: then one path for each child table can be united."""
        return bool(self.steps) and self.steps[-1][0].parent in self.requested and self.steps[-1][0].parent == self.steps[-1][1]

    def fan_out(self) -> list[Relationship]:
        """Relationships that lead from the requested tables to children outside: each multiplies requested rows."""
        have, out = set(self.requested), []
        left = [r for r, _ in self.steps]
        moved = True
        while moved:
            moved = False
            for r in list(left):
                if (r.parent in have) != (r.child in have):
                    if r.parent in have:
                        out.append(r)
                    have |= {r.parent, r.child}
                    left.remove(r)
                    moved = True
        return out


def tpch_like() -> SchemaGraph:
    """The graph of the sample tables."""
    cols = {
        "region": ("r_regionkey", "r_name"),
        "nation": ("n_nationkey", "n_name", "n_regionkey"),
        "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
        "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
        "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
        "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "lineitem": ("l_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"),
        "events": ("event_id", "user_id", "event_type", "value"),
    }
    links = [
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("events", "user_id", "customer", "c_custkey"),
    ]
    return SchemaGraph({n: TableDef(n, c[0], c) for n, c in cols.items()}, tuple(Relationship(*x) for x in links))
