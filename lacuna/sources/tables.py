"""Readers, writers, profiles, and the result cache."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.catalog import CAP


def read_csv(spark: SparkSession, path: str, names: list[str], drop: tuple[str, ...] = (), sep: str = ",", header: bool = False, numeric: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """CSV with `\\` as escape; malformed rows go; names by position; `numeric`: only rows where it is a number; columns in `types` are cast."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, schema=schema, sep=sep, quote='"', escape="\\", mode="DROPMALFORMED", header=header)
    if numeric:
        df = df.filter(F.col(numeric).try_cast("double").isNotNull())
    return df.select(*[F.col(n).try_cast((types or {}).get(n, "string")).alias(n) for n in names if n not in drop])


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=sep, escape="\\")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns that aren't there are left out."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_table(df: DataFrame, path: str, key: str, most: int = 20_000_000, seed: int = 0) -> None:
    """Parquet; a table of more than `most` rows is thinned by a hash of its key (this bound is the feature)."""
    n = df.count()
    if n > most:
        df = df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    df.write.mode("overwrite").parquet(path)


def combine(spark: SparkSession, paths: list[str], header: bool = True) -> DataFrame:
    """CSV parts united by column name; what a part doesn't have is null."""
    out = None
    for p in paths:
        part = spark.read.csv(p, header=header, inferSchema=False)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def copy_csv(spark: SparkSession, source: str, target: str, header: bool = False, sep: str = ",") -> None:
    """Rows as they are, from one place to another."""
    df = spark.read.csv(source, header=header, sep=sep, escape="\\")
    df.write.mode("overwrite").csv(target, header=header, sep=sep, escape="\\")


#: How tables are read: all rows; what removal left; what it left, with the true tuple factors.
COMPLETE, INCOMPLETE, TRUE_FACTORS = "complete", "incomplete", "incomplete, true tuple factors"


def access(mode: str, whole: dict[str, DataFrame], remaining: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """The frames of a mode. keys: the primary key of each table."""
    if mode == COMPLETE:
        return dict(whole)
    if mode == INCOMPLETE:
        return dict(remaining)
    out = {}
    for name, df in remaining.items():
        tfs = [c for c in whole[name].columns if c.startswith("tf_")]
        true = whole[name].select(F.col(keys[name]).alias("__k"), *tfs)
        out[name] = df.drop(*tfs).join(true, F.col(keys[name]) == F.col("__k"), "left").drop("__k") if tfs else df
    return out


def null_links(df: DataFrame, fks: list[str], sample_rate: float = 1.0) -> dict[str, float]:
    """For each foreign key how many rows have none, by the share of rows that the table holds."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fks]).first().asDict() if fks else {}
    return {c: n / sample_rate for c, n in row.items()}


def profile(df: DataFrame) -> dict[str, dict]:
    """Of each column: type, number of distinct values (about) and of nulls, mean for numbers. One job."""
    numeric = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    facts = [F.count("*").alias("rows")]
    for c in df.columns:
        facts += [F.approx_count_distinct(c).alias(f"{c}|distinct"), F.count_if(F.col(c).isNull()).alias(f"{c}|nulls")]
        if c in numeric:
            facts.append(F.avg(c).alias(f"{c}|mean"))
    row = df.agg(*facts).first().asDict()
    return {c: {"type": t, "rows": row["rows"], "distinct": row[f"{c}|distinct"], "nulls": row[f"{c}|nulls"], "mean": row.get(f"{c}|mean")} for c, t in df.dtypes}


def modelled(df: DataFrame, cap: int = CAP) -> DataFrame:
    """Without columns that are all null, and without strings of more than `cap` distinct values."""
    facts = profile(df)
    gone = [c for c, f in facts.items() if f["nulls"] == f["rows"] or (f["type"] == "string" and f["distinct"] > cap)]
    return df.drop(*gone)


def save_metadata(spark: SparkSession, facts: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "meta string").coalesce(1).write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def cached_result(spark: SparkSession, plan: str, folder: str, make) -> DataFrame:
    """The result of a plan, read where it has been written before, by the digest of its text."""
    import hashlib

    path = f"{folder}/{hashlib.sha224(plan.encode()).hexdigest()}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def synthetic(spark: SparkSession, parents: int, fan_out: int = 5, skew: float = 1.0, values: int = 100, predictability: float = 1.0, by_set: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """complete(id, attribute_a) with Zipf values, and incomplete(id, attribute_b, complete_id): a child's value is its parent's, but redrawn for a share of 1 - predictability. by_set: a family's value is drawn apart from its parent's."""
    from lacuna.functions.scalars import uniform

    weights = [1 / (k + 1) ** skew for k in range(values)]
    total, up, steps = sum(weights), 0.0, []
    for w in weights:
        up += w / total
        steps.append(up)
    cdf = F.array(*map(F.lit, steps))
    draw = lambda u: F.least(F.lit(values), F.size(F.filter(cdf, lambda x: x <= u)) + 1) - 1
    a = spark.range(parents).withColumn("attribute_a", draw(uniform(seed, "a", F.col("id"))))
    # Correlated sets: the value that a family shares is another draw than its parent's, so that no child follows its parent.
    shared = draw(uniform(seed, "set", F.col("id"))) if by_set else F.col("attribute_a")
    c = a.select(F.col("id").alias("complete_id"), shared.alias("shared")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1))))
    c = c.withColumn("id", F.col("complete_id") * fan_out + F.col("k"))
    redrawn = uniform(seed, "flip", F.col("id")) >= predictability
    value = F.when(redrawn, draw(uniform(seed, "b", F.col("id")))).otherwise(F.col("shared"))
    return a, c.select("id", F.concat(F.lit("v"), value.cast("string")).alias("attribute_b"), "complete_id")
