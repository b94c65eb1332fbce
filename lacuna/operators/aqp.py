"""Aggregate queries on weighted rows: COUNT, SUM and AVG with filters and GROUP BY; and how good they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import relational as R


@dataclass(frozen=True)
class AggregateQuery:
    tables: tuple[str, ...]
    attribute: str | None = None
    predicates: tuple[tuple, ...] = ()
    groups: tuple[str, ...] = ()
    keep_null_groups: bool = False

    def compute(self, df: DataFrame, upscale: Column | float = 1.0) -> DataFrame:
        """groups, n (COUNT), avg and sum. Empty input: n 0, the others null. SUM is COUNT * AVG over rows that have the attribute."""
        df = R.where(R.weighted(df), list(self.predicates))
        up = upscale if isinstance(upscale, Column) else F.lit(float(upscale))
        w, x = F.col(R.WEIGHT), F.col(self.attribute) if self.attribute else F.lit(None).cast("double")
        if self.groups and not self.keep_null_groups:
            df = df.dropna(subset=list(self.groups))
        n = F.coalesce(F.sum(w), F.lit(0.0)) * up
        avg = F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))
        out = df.groupBy(*self.groups).agg(n.alias("n"), avg.alias("avg"))
        return out.withColumn("sum", F.col("n") * F.col("avg"))

    def sql(self, view: str = "completed") -> str:
        """The query as Spark SQL over a view of the weighted rows."""
        quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        one = lambda c, op, v: f"{c} IN ({', '.join(map(quote, v))})" if op == "in" else f"{c} {op} {quote(v)}"
        cols = [*self.groups, f"sum({R.WEIGHT}) AS n"]
        if self.attribute:
            a = self.attribute
            cols.append(f"try_divide(sum({R.WEIGHT} * {a}), sum(CASE WHEN {a} IS NOT NULL THEN {R.WEIGHT} END)) AS avg")
        tests = [one(*p) for p in self.predicates] + ([] if self.keep_null_groups else [f"{g} IS NOT NULL" for g in self.groups])
        return f"SELECT {', '.join(cols)} FROM {view}" + (f" WHERE {' AND '.join(tests)}" if tests else "") + (f" GROUP BY {', '.join(self.groups)}" if self.groups else "")


def upscale(df: DataFrame, base_rows: int) -> float:
    """base rows / sum of weights, where that is over 1."""
    w = R.weighted(df).agg(F.sum(R.WEIGHT)).first()[0] or 0.0
    return base_rows / w if 0 < w < base_rows else 1.0


def mean_or_share(df: DataFrame, attribute: str, values: list | None = None) -> DataFrame:
    """Weighted mean, or weighted share of values, of the rows that have the attribute."""
    df = R.weighted(df).filter(F.col(attribute).isNotNull())
    x = F.col(attribute).isin(*values).cast("double") if values else F.col(attribute)
    return df.agg(F.try_divide(F.sum(F.col(R.WEIGHT) * x), F.sum(R.WEIGHT)).alias("value"))


def bias_reduction(pred: Column, base: Column, true: Column) -> Column:
    """1 - |(pred - true) / (base - true)|; 0 where base and truth agree."""
    return F.coalesce(1 - F.abs(F.try_divide(pred - true, base - true)), F.lit(0.0))


def cardinality_correction(pred: Column, base: Column, true: Column) -> Column:
    return F.greatest(F.lit(0.0), bias_reduction(pred, base, true))


def relative_error(truth: DataFrame, answer: DataFrame, groups: list[str], measure: str) -> DataFrame:
    """Mean of |(true - answer) / true| over the true groups that the answer has."""
    t, a = truth.select(*groups, F.col(measure).alias("__t")), answer.select(*groups, F.col(measure).alias("__a"))
    both = t.join(a, groups) if groups else t.crossJoin(a)
    return both.agg(F.avg(F.abs(F.try_divide(F.col("__t") - F.col("__a"), F.col("__t")))).alias("error"))


def improvement(truth: DataFrame, base: DataFrame, pred: DataFrame, groups: list[str], measure: str) -> DataFrame:
    b = relative_error(truth, base, groups, measure).withColumnRenamed("error", "base_error")
    p = relative_error(truth, pred, groups, measure).withColumnRenamed("error", "pred_error")
    return b.crossJoin(p).withColumn("improvement", F.col("base_error") - F.col("pred_error"))


def mean_absolute_error(pred: DataFrame, true: DataFrame, key: str, attribute: str) -> DataFrame:
    """Mean over keys of |mean of the prediction - mean of the truth|."""
    p = pred.groupBy(key).agg(F.avg(attribute).alias("p"))
    t = true.groupBy(key).agg(F.avg(attribute).alias("t"))
    return p.join(t, key).agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))


def bounds(lower: DataFrame, result: DataFrame, upper: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """A result with its confidence band, joined by its parameters."""
    side = lambda d, n: d.select(*keys, F.col(measure).alias(n))
    return side(result, "value").join(side(lower, "lower"), keys).join(side(upper, "upper"), keys)


def theoretical_bounds(base: Column, keep: Column) -> tuple[Column, Column]:
    return keep * base, keep * base + (1 - keep)


def suspected(df: DataFrame, group: list[str], value: str, candidate: str, high: bool) -> DataFrame:
    """Of the candidates of each group, the extreme one in the direction of the suspected bias; ties to the smaller candidate."""
    best = df.groupBy(*group).agg(F.min(F.struct((-F.col(value) if high else F.col(value)).alias("v"), candidate)).alias("x"))
    return best.select(*group, F.col(f"x.{candidate}").alias(candidate), (-F.col("x.v") if high else F.col("x.v")).alias(value))


def most_and_least_common(df: DataFrame, column: str) -> DataFrame:
    """One row: the most and the least frequent value, ties to the smaller value; null is no value."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    value = F.col(column)
    # Of values with one number the smaller: the extremes of (number, value) need a second look at the values of that number.
    ends = n.agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    both = n.crossJoin(F.broadcast(ends))  # one row
    return both.agg(F.min(F.when(F.col("n") == F.col("hi"), value)).alias("most"), F.min(F.when(F.col("n") == F.col("lo"), value)).alias("least"))


def group_mean(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """The mean of an attribute for each key; null where all are null."""
    return df.groupBy(key).agg(F.avg(attribute).alias("mean"))


def rollup(results: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Of the results of many runs: number, mean, least and largest by parameters, in their order."""
    return results.groupBy(*by).agg(F.count(measure).alias("runs"), F.avg(measure).alias("mean"), F.min(measure).alias("min"), F.max(measure).alias("max")).orderBy(*by)
