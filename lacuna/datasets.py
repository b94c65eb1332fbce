"""Datasets by name: their graph, how their tables are read, and their aggregate queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import catalog
from lacuna.operators.aqp import AggregateQuery
from lacuna.sources import tables


@dataclass(frozen=True)
class Dataset:
    graph: catalog.SchemaGraph
    load: Callable[[SparkSession, str], dict[str, DataFrame]]
    queries: dict[str, AggregateQuery]


def surrogate(items: DataFrame) -> DataFrame:
    """lineitem has no unique key, but no two equal rows: a hash of the row (kept within 62 bits)."""
    return items.withColumn("l_id", F.xxhash64(*items.columns).bitwiseAND(F.lit((1 << 62) - 1)))


def _sample(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in catalog.tpch_like().tables}
    return frames | {"lineitem": surrogate(frames["lineitem"])}


def _synthetic(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    complete, incomplete = tables.synthetic(spark, 1000, values=20, predictability=0.8)
    return {"complete": complete, "incomplete": incomplete}


def synthetic_graph() -> catalog.SchemaGraph:
    defs = [catalog.TableDef("complete", "id", ("id", "attribute_a")), catalog.TableDef("incomplete", "id", ("id", "attribute_b", "complete_id"))]
    return catalog.SchemaGraph({t.name: t for t in defs}, (catalog.Relationship("incomplete", "complete_id", "complete", "id"),), frozenset({"complete"}))


#: Over one table and over joins; counts and means, with ranges, lists and groups.
SAMPLE_QUERIES = {
    "orders_by_status": AggregateQuery(("orders",), None, (), ("o_orderstatus",)),
    "orders_urgent": AggregateQuery(("orders",), None, (("o_orderpriority", "in", ("1-URGENT", "2-HIGH")),)),
    "price_by_priority": AggregateQuery(("orders",), "o_totalprice", (), ("o_orderpriority",)),
    "price_of_finished": AggregateQuery(("orders",), "o_totalprice", (("o_orderstatus", "=", "F"), ("o_totalprice", ">=", 1000))),
    "orders_by_segment": AggregateQuery(("customer", "orders"), None, (("o_orderstatus", "!=", "P"),), ("c_mktsegment",)),
    "price_by_segment": AggregateQuery(("customer", "orders"), "o_totalprice", (("c_acctbal", ">", 0),), ("c_mktsegment",)),
    "items_by_flag": AggregateQuery(("orders", "lineitem"), "l_quantity", (), ("l_returnflag",)),
}
SYNTHETIC_QUERIES = {
    "by_value": AggregateQuery(("incomplete",), None, (), ("attribute_b",)),
    "most_frequent": AggregateQuery(("incomplete",), None, (("attribute_b", "=", "v0"),)),
}

DATASETS = {
    "sample": Dataset(catalog.tpch_like(), _sample, SAMPLE_QUERIES),
    "synthetic": Dataset(synthetic_graph(), _synthetic, SYNTHETIC_QUERIES),
}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"no dataset {name}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name]
