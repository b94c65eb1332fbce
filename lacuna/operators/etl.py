"""Preparation of raw tables: normalising, enriching, splitting."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.catalog import CAP, SchemaGraph
from lacuna.operators import relational as R, tuple_factors
from lacuna.sources import tables


def normalize_by_key(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A table of the distinct (key, columns), and the rest with the key."""
    return df.select(key, *columns).distinct(), df.drop(*columns)


def normalize_by_values(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """A table of the distinct values with a dense number from 0, and the rest with that number."""
    dim = R.numbered(df.select(*columns).distinct(), columns, name)
    named = dim.select(*[F.col(c).alias(f"__{c}") for c in columns], name)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return dim, df.join(named, on).drop(*columns, *[f"__{c}" for c in columns])


def enrich(df: DataFrame, key: str, info: DataFrame, info_key: str, kind: str, value: str, kinds: dict, order: str) -> DataFrame:
    """For each (kind -> column) the first value of that kind as a column; one pass over the typed rows."""
    first = R.first_per_key(info.filter(F.col(kind).isin(*kinds)), [info_key, kind], [order])
    wide = first.groupBy(F.col(info_key).alias("__k")).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(c) for k, c in kinds.items()])
    return df.join(wide, F.col(key) == F.col("__k"), "left").drop("__k")


def split_by_role(links: DataFrame, people: DataFrame, role: str, roles: dict[str, list], link_key: str, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each name: the links of its roles, and the people who have one."""
    out = {}
    for name, ids in roles.items():
        mine = links.filter(F.col(role).isin(*ids))
        out[name] = (mine, R.in_keys(people, key, mine.select(link_key)))
    return out


def prepare(graph: SchemaGraph, frames: dict[str, DataFrame], folder: str, cap: int = CAP, sample_rate: float = 1.0) -> dict[str, dict]:
    """Raw tables made ready: modelled columns and keys only, with the tuple factors of all relationships, written to a
    folder. Of each table: its profile, null links, and of each tuple factor the percentiles and the parents without a child."""
    facts = {}
    for name in graph.topological():
        df, mine = frames[name], [r for r in graph.relationships if r.parent == name]
        links = [r.fk for r in graph.relationships if r.child == name]
        keys = dict.fromkeys([graph.tables[name].key, *links])
        ignored = set(graph.tables[name].ignored) - set(keys)
        df = df.select(*keys, *[c for c in tables.modelled(df.drop(*keys, *ignored), cap).columns])
        for r in mine:
            df = tuple_factors.add_tf(df, frames[r.child].select(r.fk), r, sample_rate=sample_rate)
        tables.write_table(df, f"{folder}/{name}", graph.tables[name].key)
        done = df.sparkSession.read.parquet(f"{folder}/{name}")
        facts[name] = {
            "profile": tables.profile(done),
            "null links": tables.null_links(done, links, sample_rate),
            "tuple factors": {r.tf: tuple_factors.percentiles(done, r.tf).first().asDict() | {"without": done.filter(F.col(r.tf) == 0).count()} for r in mine},
        }
    return facts


def parameter_grid(**lists) -> list[dict]:
    """All combinations of parameters, for series of scenarios."""
    return [dict(zip(lists, values)) for values in itertools.product(*lists.values())]
