"""How good a completion is: against the truth, and against what the incomplete tables say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import aqp
from lacuna.operators.removal import Removal

MEASURES = ["attribute", "true", "base", "pred", "bias_reduction", "true_rows", "base_rows", "pred_rows", "cardinality_correction"]


def of_removal(x: Removal, truth: DataFrame, base: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of MEASURES: the mean of a numeric attribute (bias), or the share of its values (categorical)."""
    if x.kind == "uniform" or not x.attribute:
        raise ValueError("a uniform removal biases no attribute")
    values = list(x.values) if x.kind == "categorical" else None
    side = lambda df, n: aqp.mean_or_share(df, x.attribute, values).withColumnRenamed("value", n).crossJoin(aqp.AggregateQuery(()).compute(df).select(F.col("n").alias(f"{n}_rows")))
    one = side(truth, "true").crossJoin(side(base, "base")).crossJoin(side(pred, "pred"))
    c = F.col
    return one.select(
        F.lit(x.attribute).alias("attribute"),
        "true",
        "base",
        "pred",
        aqp.bias_reduction(c("pred"), c("base"), c("true")).alias("bias_reduction"),
        "true_rows",
        "base_rows",
        "pred_rows",
        aqp.cardinality_correction(c("pred_rows"), c("base_rows"), c("true_rows")).alias("cardinality_correction"),
    )


def evaluate(removals: list[Removal], truth: DataFrame, base: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each removal that biases an attribute which the join has."""
    rows = [of_removal(x, truth, base, pred) for x in removals if x.kind != "uniform" and x.attribute in truth.columns]
    if not rows:
        raise ValueError("no removal biases an attribute of the join")
    return reduce(DataFrame.unionByName, rows)


def evaluate_queries(queries: dict[str, aqp.AggregateQuery], requested: set[str], truth: DataFrame, base: DataFrame, pred: DataFrame, base_rows: int | None = None) -> DataFrame:
    """name, base_error, pred_error and improvement of each query over exactly the requested tables. base_rows: what the
    prediction's counts are scaled up to, where its weights fall short."""
    rows = []
    for name, q in sorted(queries.items()):
        if set(q.tables) != requested:
            continue
        up = aqp.upscale(pred, base_rows) if base_rows else 1.0
        measure = "avg" if q.attribute else "n"
        x = aqp.improvement(q.compute(truth), q.compute(base), q.compute(pred, up), list(q.groups), measure)
        rows.append(x.select(F.lit(name).alias("name"), "base_error", "pred_error", "improvement"))
    if not rows:
        raise ValueError(f"no query over {sorted(requested)}")
    return reduce(DataFrame.unionByName, rows)
