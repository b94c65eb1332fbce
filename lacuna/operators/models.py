"""Conditional models by counts with back-off, and sampling by inverse distribution functions.

p(column | context) is a table of contexts with an array of (hi, value): the cumulative probability up to each value. A
model reads its training rows once: the counts of the full context are stored, and those of shorter contexts are sums
of them. Contexts back off from all their columns to none: a context with less than `support` rows isn't used. A draw
is a hash number u, an equi-join on the context (by broadcast where the model is small) and the first value with
u < hi; nothing is collected. A column of many values (WIDE) is drawn from pieces of the arrays: the range of u is cut
into as many equal parts as a context has values (by PIECE), and a draw meets the values of its part alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lacuna.functions import scalars
from lacuna.functions.scalars import uniform
from lacuna.sources.scratch import SMALL, small_side, stored

#: Values of a column beyond which a draw meets a piece of a context's array, of about PIECE values, instead of all of it.
WIDE, PIECE = 256, 16


def domain(df: DataFrame, column: str) -> DataFrame:
    """code (from 1; 0 stands for null or unseen), value and prior."""
    n = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    code = F.row_number().over(W.orderBy("value"))  # one row a distinct value, at most the cap of the profile
    return n.crossJoin(F.broadcast(total)).select(code.alias("code"), "value", (F.col("n") / F.col("total")).alias("prior"))


def encode(df: DataFrame, column: str, dom: DataFrame) -> DataFrame:
    d = dom.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(d, F.col(column) == F.col("__v"), "left").withColumn(f"{column}__code", F.coalesce("__c", F.lit(0))).drop("__v", "__c")


def decode(df: DataFrame, column: str, dom: DataFrame) -> DataFrame:
    d = dom.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(d, F.col(f"{column}__code") == F.col("__c"), "left").withColumn(column, F.col("__v")).drop("__v", "__c", f"{column}__code")


@dataclass
class CountModel:
    """p(column | parents), with back-off over shorter and shorter lists of parents. rows: of the finest counts; values:
    of the column. flat: each level as rows (parents..., __lo, __hi, __value), where they are known without the arrays."""

    column: str
    levels: list[tuple[list[str], DataFrame]]
    rows: int
    values: int = 0
    flat: list[DataFrame] | None = None

    @classmethod
    def fit(cls, df: DataFrame, column: str, parents: list[str], support: int = 20, smooth: float = 0.0, weight: Column | None = None) -> CountModel:
        """weight: multiplies the count of a value (as 1 / tf for tuple factors)."""
        full = df.filter(F.col(column).isNotNull()).groupBy(*[F.col(p).alias(f"__{p}") for p in parents], F.col(column).alias("__value")).agg(F.count("*").alias("__n"))
        full, levels, flat = stored(full, f"model-{column}"), [], []
        for k in range(len(parents), -1, -1):
            own = [f"__{p}" for p in parents[:k]]
            n = full if k == len(parents) else full.groupBy(*own, "__value").agg(F.sum("__n").alias("__n"))
            w = W.partitionBy(*(own or [F.lit(1)]))
            mass = (F.col("__n") + F.lit(smooth)) * (F.lit(1.0) if weight is None else weight)
            n = n.withColumn("__rows", F.sum("__n").over(w)).withColumn("__m", mass)
            # A context without any mass falls back to its counts.
            n = n.withColumn("__m", F.when(F.sum("__m").over(w) > 0, F.col("__m")).otherwise(F.col("__n")))
            up = F.sum("__m").over(w.orderBy("__value").rowsBetween(W.unboundedPreceding, 0)) / F.sum("__m").over(w)
            n = n.withColumn("__hi", up)
            flat.append(n.withColumn("__lo", F.lag("__hi", 1, 0.0).over(w.orderBy("__value"))).filter(F.col("__rows") >= (support if k else 1)).select(*own, "__lo", "__hi", "__value"))
            n = n.filter(F.col("__rows") >= (support if k else 1))
            levels.append((parents[:k], n.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(F.col("__hi").alias("hi"), F.col("__value").alias("value")))).alias("__cdf"))))
        rows = full.count()
        values = full.agg(F.count_distinct("__value")).first()[0] if parents and rows > WIDE else rows
        return cls(column, levels, rows, values, flat)

    def _masses(self, cdf: str = "__cdf") -> Column:
        """An array of (value, p) in the order of the values."""
        low = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.get(cdf, i - 1)["hi"])
        return F.transform(cdf, lambda x, i: F.struct(x["value"].alias("value"), (x["hi"] - low(i)).alias("p")))

    def probabilities(self) -> DataFrame:
        """(parents..., value, p) of the full context."""
        own, t = self.levels[0]
        return t.select(*[F.col(f"__{p}").alias(p) for p in own], F.inline(self._masses()))

    def bounded(self, value, quantile: float, strength: float) -> CountModel:
        """The model whose probability of a value is mixed with its `quantile` of belief (above 0.5: up to 1, below: down
        to 0); the other values share the rest. Weight 1 - strength goes to the belief, the rest to what was learned."""
        prior = self.levels[-1][1].select(self._masses().alias("__prior"))
        levels = []
        for own, t in self.levels:
            t = t.crossJoin(F.broadcast(prior))  # one row of the column's values
            known = F.map_from_entries(self._masses())
            others = F.greatest(F.size("__prior") - 1, F.lit(1))
            of = F.element_at(F.filter("__prior", lambda x: x["value"] == value), 1)["p"]
            t = t.withColumn("__known", known).withColumn("__of", F.coalesce(of, F.lit(0.0))).withColumn("__others", others)
            mix = lambda x: scalars.percentile_mix(F.coalesce(F.try_element_at("__known", x["value"]), F.lit(0.0)), F.col("__of"), x["value"] == value, F.lit(quantile), F.lit(strength), F.col("__others"))
            p = F.transform("__prior", lambda x: F.struct(x["value"].alias("value"), mix(x).alias("p")))
            t = t.withColumn("__p", p).withColumn("__sum", F.aggregate("__p", F.lit(0.0), lambda a, x: a + x["p"]))
            up = lambda i: F.aggregate(F.slice("__p", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["p"]) / F.col("__sum")
            cdf = F.transform("__p", lambda x, i: F.struct(up(i).alias("hi"), x["value"].alias("value")))
            levels.append((own, t.select(*[f"__{p}" for p in own], cdf.alias("__cdf"))))
        return CountModel(self.column, levels, self.rows, self.values)

    def without(self, value) -> CountModel:
        """The model in which a value (as the code of null) has no probability; a context that has only it is left out."""
        levels = []
        for own, t in self.levels:
            t = t.withColumn("__p", F.filter(self._masses(), lambda x: x["value"] != value))
            t = t.withColumn("__sum", F.aggregate("__p", F.lit(0.0), lambda a, x: a + x["p"])).filter("__sum > 0")
            up = lambda i: F.aggregate(F.slice("__p", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["p"]) / F.col("__sum")
            cdf = F.transform("__p", lambda x, i: F.struct(up(i).alias("hi"), x["value"].alias("value")))
            levels.append((own, t.select(*[f"__{p}" for p in own], cdf.alias("__cdf"))))
        return CountModel(self.column, levels, self.rows, self.values)

    def sample(self, df: DataFrame, u: Column, name: str | None = None) -> DataFrame:
        """The column drawn for each row of df by its u in (0, 1)."""
        name = name or self.column
        df = df.drop(name).withColumn("__u", u)
        if self.values > WIDE:
            return self._sample_pieces(df, name)
        for i, (own, t) in enumerate(self.levels):
            t = t.withColumnRenamed("__cdf", f"__cdf{i}")
            if own:
                on = [F.col(p) == F.col(f"__{p}") for p in own]
                df = df.join(F.broadcast(t) if self.rows <= SMALL else t, on, "left").drop(*[f"__{p}" for p in own])
            else:
                df = df.join(F.broadcast(t), F.lit(True), "left")  # one row, as long as the column has values
        cdf = F.coalesce(*[f"__cdf{i}" for i in range(len(self.levels))])
        hit = F.filter(cdf, lambda x: (F.col("__u") < x["hi"]) | (x["hi"] >= 1 - 1e-12))
        return df.withColumn(name, F.get(hit, F.lit(0))["value"]).drop("__u", *[f"__cdf{i}" for i in range(len(self.levels))])

    def _rows(self, i: int) -> DataFrame:
        """A level as rows: parents, and the part [__lo, __hi) of each value."""
        if self.flat:
            return self.flat[i]
        own, t = self.levels[i]
        low = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.get("__cdf", i - 1)["hi"])
        return t.select(*[f"__{p}" for p in own], F.inline(F.transform("__cdf", lambda x, i: F.struct(low(i).alias("__lo"), x["hi"].alias("__hi"), x["value"].alias("__value")))))

    def _sample_pieces(self, df: DataFrame, name: str) -> DataFrame:
        """sample() of a wide column: __u's part of the context is a key of the join, so a row meets few values."""
        small = (lambda t: F.broadcast(t)) if self.rows <= SMALL else (lambda t: t)
        for i, (own, _) in enumerate(self.levels):
            keys = [f"__{p}" for p in own]
            rows = stored(self._rows(i).filter("__lo < __hi"), f"pieces-{self.column}")
            parts = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.count("*") / PIECE).cast("long").alias("__parts"))
            parts = small(parts) if self.rows <= SMALL or not own else small_side(stored(parts, f"parts-{self.column}"))
            at = lambda x: F.least(F.col("__parts") - 1, F.floor(F.col(x) * F.col("__parts")))
            cut = rows.join(parts, keys) if own else rows.crossJoin(F.broadcast(parts))  # one row
            cut = cut.withColumn("__part", F.explode(F.sequence(at("__lo"), at("__hi")))).groupBy(*keys, "__part")
            cut = cut.agg(F.array_sort(F.collect_list(F.struct(F.col("__hi").alias("hi"), F.col("__value").alias("value")))).alias("__cdf"))
            cut = cut.select(*[F.col(k).alias(f"{k}__cut") for k in keys], F.col("__part").alias("__of"), "__cdf")
            df = df.join(parts, [F.col(p) == F.col(f"__{p}") for p in own], "left") if own else df.join(F.broadcast(parts), F.lit(True), "left")
            on = [F.col(p) == F.col(f"__{p}__cut") for p in own] + [at("__u") == F.col("__of")]
            df = df.join(small(cut), on, "left").drop(*keys, *[f"{k}__cut" for k in keys], "__of", "__parts")
            hit = F.filter("__cdf", lambda x: (F.col("__u") < x["hi"]) | (x["hi"] >= 1 - 1e-12))
            df = df.withColumn(f"__value{i}", F.get(hit, F.lit(0))["value"]).drop("__cdf")
        drawn = [f"__value{i}" for i in range(len(self.levels))]
        return df.withColumn(name, F.coalesce(*drawn)).drop("__u", *drawn)

    def save(self, path: str) -> None:
        """One folder a level, and the names."""
        for i, (_, t) in enumerate(self.levels):
            t.write.mode("overwrite").parquet(f"{path}/level{i}")
        names = [(self.column, self.rows, [own for own, _ in self.levels], self.values)]
        self.levels[0][1].sparkSession.createDataFrame(names, "column string, rows long, levels array<array<string>>, values long").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark, path: str) -> CountModel:
        names = spark.read.parquet(f"{path}/names").first()
        return cls(names["column"], [(list(own), spark.read.parquet(f"{path}/level{i}")) for i, own in enumerate(names["levels"])], names["rows"], names.asDict().get("values") or 0)


def sample_columns(df: DataFrame, train: DataFrame, columns: list[str], evidence: list[str], key: str, seed: int = 0, support: int = 20, most_parents: int = 2) -> DataFrame:
    """Columns drawn one after the other, each given evidence and the last drawn ones."""
    if not columns:
        return df
    parents = list(evidence)
    for c in columns:
        model = CountModel.fit(train, c, parents[-most_parents:] if most_parents else [], support)
        df = model.sample(df, uniform(seed, c, F.col(key)))
        parents.append(c)
    return df


def negative_log_likelihood(df: DataFrame, model: CountModel) -> DataFrame:
    """Mean -ln p of the rows whose context and value the model has."""
    own, _ = model.levels[0]
    p = model.probabilities()
    cond = df[model.column] == p["value"]
    for o in own:
        cond = cond & (df[o] == p[o])
    return df.join(p, cond).agg((-F.avg(F.ln(p["p"]))).alias("nll"))


def set_evidence(parents: DataFrame, children: DataFrame, pk: str, fk: str, child_key: str, columns: list[str], most: int = 10, exclude: str | None = None) -> DataFrame:
    """The first `most` children of each parent as an array of structs (the cap is the feature), and their number."""
    kids = children.filter(F.col(fk).isNotNull())
    nth = F.row_number().over(W.partitionBy(fk).orderBy(child_key))
    kids = kids.withColumn("__n", nth).filter(F.col("__n") <= most)
    kids = kids.groupBy(F.col(fk).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(child_key, *columns))).alias("set"))
    out = parents.join(kids, F.col(pk) == F.col("__k"), "left").drop("__k")
    if exclude:
        out = out.withColumn("set", F.filter("set", lambda x: x[child_key] != F.col(exclude)))
    return out.withColumn("set_size", F.coalesce(F.size("set"), F.lit(0)))
