"""Parts of the engine that no query over the sample tables covers, on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import catalog
from lacuna.catalog import Path, Relationship, SchemaGraph, TableDef
from lacuna.datasets import DATASETS, dataset
from lacuna.functions import scalars as S
from lacuna.operators import aqp, completion, etl, models, relational as R, removal
from lacuna.plans import planner, setups
from lacuna.sources import tables

PC = Relationship("child", "parent_id", "parent", "pid")
GRAPH = SchemaGraph({"parent": TableDef("parent", "pid", ("pid", "a")), "child": TableDef("child", "cid", ("cid", "parent_id", "b"))}, (PC,), frozenset({"parent"}))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('1,"a, b",x\n2,"say \\"hi\\"",y\nno,c,z\n')
    df = tables.read_csv(spark, str(tmp_path / "in.csv"), ["id", "text", "gone"], drop=("gone",), numeric="id", types={"id": "int"})
    assert rows(df) == [(1, "a, b"), (2, 'say "hi"')] and dict(df.dtypes)["id"] == "int"
    tables.write_csv(df, str(tmp_path / "out"))
    tables.write_csv(df.withColumn("more", F.lit(1)), str(tmp_path / "out2"))
    both = tables.combine(spark, [str(tmp_path / "out"), str(tmp_path / "out2")])
    assert both.count() == 4 and both.filter("more is null").count() == 2
    tables.copy_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "copy"))
    assert spark.read.csv(str(tmp_path / "copy")).count() == 3


def test_tables(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id"))).withColumn("name", F.col("id").cast("string")).withColumn("none", F.lit(None).cast("string"))
    tables.write_table(df, str(tmp_path / "t"), "id", most=200)
    assert 100 < tables.read_parquet(spark, str(tmp_path / "t"), ["id", "absent"]).count() < 320
    facts = tables.profile(df)
    assert facts["v"]["nulls"] == 500 and facts["v"]["mean"] == 499 and facts["id"]["rows"] == 1000
    assert tables.modelled(df, cap=100).columns == ["id", "v"]
    assert tables.null_links(df, ["v"], 0.5) == {"v": 1000}
    tables.save_metadata(spark, {"a": [1, 2]}, str(tmp_path / "m"))
    assert tables.load_metadata(spark, str(tmp_path / "m")) == {"a": [1, 2]}
    made = []
    for _ in range(2):
        got = tables.cached_result(spark, "plan", str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3))
    assert got.count() == 3 and len(made) == 1


def test_access(spark):
    whole = {"parent": spark.createDataFrame([(1, 2), (2, 0)], "pid long, tf_x long")}
    left = {"parent": spark.createDataFrame([(1, None)], "pid long, tf_x long")}
    for mode, want in ((tables.COMPLETE, [(1, 2), (2, 0)]), (tables.INCOMPLETE, [(1, None)]), (tables.TRUE_FACTORS, [(1, 2)])):
        assert rows(tables.access(mode, whole, left, {"parent": "pid"})["parent"]) == want


@pytest.mark.parametrize("by_set", [False, True])
def test_synthetic(spark, by_set):
    a, c = tables.synthetic(spark, 400, 5, 1.0, 20, 1.0, by_set)
    j = a.join(c, a["id"] == c["complete_id"]).withColumn("same", F.concat(F.lit("v"), "attribute_a") == F.col("attribute_b"))
    alike = j.groupBy("complete_id").agg(F.countDistinct("attribute_b").alias("n")).filter("n = 1").count()
    share = j.agg(F.avg(F.col("same").cast("double"))).first()[0]
    assert alike == 400 and (share < 0.5 if by_set else share == 1.0)


@pytest.mark.parametrize("keys", [[1000004, -1000004, 0, 5], [2**61, -(2**61), 7, -7]])
def test_synthetic_keys(spark, keys):
    p = spark.createDataFrame([(k, 3, "a") for k in keys], "pid long, tf_child_parent_id int, a string")
    c = spark.createDataFrame([(1, keys[0], "x")], "cid long, parent_id long, b string")
    done = completion.join_1n(p, c, PC, p, "cid", ["b"], [])
    ids = [r["cid"] for r in done.filter(completion.SYNTHETIC).collect()]
    assert len(ids) == 11 == len(set(ids)) and max(ids) < 0
    again = [r["cid"] for r in completion.join_1n(p.repartition(3), c, PC, p, "cid", ["b"], []).filter(completion.SYNTHETIC).collect()]
    assert sorted(ids) == sorted(again)


def test_synthetic_parents(spark):
    p = spark.createDataFrame([(1, 1, "a")], "pid long, tf_child_parent_id int, a string")
    c = spark.createDataFrame([(1, 1, "x"), (5, None, "x"), (-5, None, "y"), (2**61, None, "y")], "cid long, parent_id long, b string")
    done = completion.join_n1(c, p, PC, "cid", ["a"], ["b"])
    made = done.filter(completion.SYNTHETIC)
    assert made.select("pid").distinct().count() == 3 and made.filter("pid < 0 and a = 'a' and tf_child_parent_id >= 1").count() == 3
    assert set(completion.check_completed(done, "pid", ["tf_child_parent_id"]).values()) == {0}


def test_completion_of_nothing(spark):
    p = spark.createDataFrame([(1, 0, "a")], "pid long, tf_child_parent_id int, a string")
    c = spark.createDataFrame([], "cid long, parent_id long, b string")
    assert completion.join_1n(p, c, PC, p, "cid", ["b"], ["a"]).count() == 0
    assert completion.join_1n(p.limit(0), c, PC, p.limit(0), "cid", ["b"], ["a"]).count() == 0


def test_scaled_factors(spark):
    # One parent has more children than it should: the others' lacks are scaled down.
    p = spark.createDataFrame([(1, 1, "a"), (2, 4, "a")], "pid long, tf_child_parent_id int, a string")
    c = spark.createDataFrame([(i, 1, "x") for i in range(3)], "cid long, parent_id long, b string")
    x = {r["pid"]: r["__missing"] for r in completion.missing_children(p, c, PC, p, []).collect()}
    assert x == {1: 0, 2: 2}
    x = {r["pid"]: r["__missing"] for r in completion.missing_children(p, c, PC, p, [], normalize=False).collect()}
    assert x == {1: 0, 2: 4}


def test_no_mass(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 3)], "g string, v int")
    m = models.CountModel.fit(df, "v", ["g"], support=1, weight=F.when(F.col("__value") > 0, 1.0).otherwise(0.0))
    assert rows(m.probabilities()) == [("a", 0, 1.0), ("b", 3, 1.0)]


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")] * 30 + [("b", "y")] * 5, "g string, v string")
    m = models.CountModel.fit(df, "v", ["g"])
    m.save(str(tmp_path / "m"))
    back = models.CountModel.load(spark, str(tmp_path / "m"))
    ask = spark.createDataFrame([("a",), ("b",), (None,)], "g string")  # b has too few rows, null none: the marginal answers
    for model in (m, back):
        got = rows(model.sample(ask, F.lit(0.95)))
        assert got == [("a", "x"), ("b", "y"), (None, "y")]
    ends = rows(m.sample(ask, F.lit(1.0)))
    assert ends == [("a", "x"), ("b", "y"), (None, "y")]


def test_first_keys_by_order(spark):
    df = spark.range(20_000).withColumn("x", F.when(F.col("id") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("id") % 977).cast("double"))
    for rate in (0.0, 0.001, 0.5, 0.9, 0.95, 1.0):
        want = sorted((x, i) for i, x in df.select("id", "x").collect())[: int(rate * 20_000)]
        assert {r["id"] for r in removal._first(df, "id", F.col("x"), rate).collect()} == {i for _, i in want}


def test_removal_directions(spark):
    df = spark.range(4000).withColumn("a", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double"))
    mean = {rho: df.join(removal.bias_keys(df, "id", "a", 0.3, rho), "id").agg(F.avg("a")).first()[0] for rho in (-0.9, 0.0, 0.9)}
    assert mean[-0.9] < mean[0.0] - 20 and mean[0.9] > mean[0.0] + 20
    values = df.withColumn("c", F.when(F.col("a") > 500, "hi").otherwise("lo"))
    kept = values.join(removal.categorical_keys(values, "id", "c", ["hi"], 0.3, 0.9), "id")
    assert kept.count() == 1200 and kept.filter("c = 'hi'").count() > 700
    with pytest.raises(ValueError):
        removal.Removal("t", "bias").kept(df, "id", 0)


def test_discretize(spark):
    got = [r[0] for r in spark.range(0, 101, 25).select(S.discretize(F.col("id"), F.lit(0), F.lit(100), 5)).collect()]
    assert got == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_greedy_is_the_rule():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m, window = int(rng.integers(0, 12)), int(rng.integers(0, 12)), int(rng.integers(1, 5))
        t, c = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        parts, free, want = max(1, -(-n // window)), set(range(m)), []
        cuts = np.linspace(0, m, parts + 1).astype(int)
        for i in range(n):
            own = [j for j in range(cuts[i // window], cuts[i // window + 1]) if j in free] or sorted(free)
            best = min(own, key=lambda j: ((t[i] - c[j]) ** 2).sum(), default=-1)
            free.discard(best)
            want.append(best)
        assert completion.greedy(t, c, window).tolist() == want


def test_one_to_one(spark):
    near = [(1, 11, 1.0), (1, 12, 2.0), (2, 11, 0.5), (2, 12, 9.0), (3, 12, 3.0), (3, 13, 3.0)]
    got = rows(completion.one_to_one(spark.createDataFrame(near, "existing long, synthetic long, d double")))
    assert got == [(1, 12, 2.0), (2, 11, 0.5), (3, 13, 3.0)]


@pytest.mark.parametrize("approximate", [False, True])
def test_replacement(spark, approximate):
    p = spark.createDataFrame([(1, 2, 0.0, "a"), (2, 1, 50.0, "b"), (3, None, 9.0, "c")], "pid long, tf_child_parent_id int, x double, a string")
    df = spark.createDataFrame([(10, 1, 1, 0.0, "a", 2), (11, None, -1, 1.0, "z", 7), (12, None, -2, 49.0, "z", 7), (13, None, -3, 48.0, "z", 7)], "cid long, parent_id long, pid long, x double, a string, tf_child_parent_id int")
    got = {r["cid"]: (r["pid"], r["parent_id"], r["a"]) for r in completion.replace_parents(df, p, PC, "cid", ["x"], approximate=approximate).collect()}
    assert got == {10: (1, 1, "a"), 11: (1, 1, "a"), 12: (2, 2, "b"), 13: (-3, None, "z")}


def test_appearance(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i if i % 2 else None, float(i)) for i in range(40)], "x double, y double, cur double")
    out = completion.expected_appearance(df, ["x"], "y", "cur").toPandas()
    assert (out.expected >= out.cur).all() and (out.expected[out.y.notna()] == out.y.dropna()).all()


def test_paths_and_plans(spark):
    g = catalog.tpch_like().with_complete("nation", "events")
    found = planner.candidates(g, {"customer"})
    assert {p.start for p in found} == {"nation", "events"}
    assert [p.start for p in planner.candidates(g, {"customer"}, {"nation"})] == ["nation"]
    assert planner.plan(g, {"customer"}, {"events"}).branches[0].incoming and not planner.plan(g, {"customer"}, {"nation"}).branches[0].incoming
    worse = planner.plan(g, {"customer"}, score=lambda p: -1.0)
    s = planner.Scenario(g, {"customer": spark.createDataFrame([(1, "x")], "c_custkey long, c_name string")}, {})
    assert worse.branches == [] and rows(planner.execute(s, worse, ["c_name"])) == [("x", 1.0)]
    assert "customer" in planner.plan(g, {"customer"}).explain()
    with pytest.raises(ValueError):
        planner.plan(catalog.tpch_like(), {"customer"})


def test_selection():
    S_ = planner.Selection
    assert planner.select(S_.NONE, [], []) == 0 and planner.select(S_.ARTIFICIAL_BIAS, [-1, -2], [1, 2]) is None
    assert planner.select(S_.ARTIFICIAL_BIAS, [0.1, 0.9], [1, 2]) == 1 and planner.select(S_.UNIFORM_MAE, [0.1, 0.9], [1, 2]) == 0
    assert planner.select(S_.COMBINED, [0.0, 1.0], [2.0, 1.0]) == 1


def test_timed_run(spark, tmp_path):
    p = spark.createDataFrame([(i, 2, "a" if i % 2 else "b") for i in range(60)], "pid long, tf_child_parent_id int, a string")
    c = spark.createDataFrame([(i, i % 60, "x" if i % 2 else "y") for i in range(90)], "cid long, parent_id long, b string")
    s = planner.Scenario(GRAPH, {"parent": p, "child": c}, {"parent": ["a"], "child": ["b"]})
    plan = planner.plan(GRAPH, {"child"})
    one = planner.execute_timed(s, plan, ["b"], str(tmp_path / "runs"))
    two = planner.execute_timed(s, plan, ["b"], str(tmp_path / "runs"))
    assert one.stats == two.stats == [{"rows": 120, "weight": 120.0, "branches": 1}] and rows(one.rows) == rows(two.rows)
    other = planner.Scenario(GRAPH, {"parent": p, "child": c.withColumn("b", F.lit("z"))}, s.attributes, name="other")
    assert planner.execute_timed(other, plan, ["b"], str(tmp_path / "runs")).rows.filter("b != 'z'").isEmpty()
    more = planner.validation(s, removal.Removal("child", "uniform", 0.5))
    assert more.frames["child"].count() == 45
    assert planner.ground_truth(GRAPH, s.frames, {"parent", "child"}).count() == 90


def test_setups():
    g = catalog.tpch_like().with_complete("region")
    known = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_mktsegment"]}
    path = g.paths({"customer"})[0]
    steps = setups.of_path(path, known)
    assert [x.evidence for x in steps] == [("r_name",), ("r_name", "n_name")] and steps[1].targets == ("tf_customer_c_nationkey", "c_mktsegment")
    short = setups.Setup(steps[1].relationship, True, ("n_name",), steps[1].targets)
    assert setups.merged([*steps, short]) == steps and setups.chosen([short, steps[0]], steps[1]) == short and setups.chosen(steps, short) is None
    assert len(setups.of_all_joins(g, known, 2)) >= 2 and set(setups.of_tables(g, known, [{"customer"}])) >= set(steps)
    assert [t for t in setups.reduced(path, 1).tables] == ["nation", "customer"]
    assert setups.with_sets(steps[1], g).sets == ("tf_supplier_s_nationkey",)
    assert setups.expanded(short, {"n_name": ("a", "b")}).evidence == ("a", "b") and setups.PRESETS["counts"]["support"] == 20


def test_graphs():
    g = catalog.tpch_like()
    order = g.topological()
    assert all(order.index(r.parent) < order.index(r.child) for r in g.relationships)
    assert "kunde" in g.renamed({"customer": "kunde"}).tables and any(r.parent == "kunde" for r in g.renamed({"customer": "kunde"}).relationships)
    with pytest.raises(ValueError):
        SchemaGraph({"a": TableDef("a", "id", ("id",))}, (Relationship("a", "x", "a", "id"),))
    with pytest.raises(ValueError):
        dataset("none")
    assert set(DATASETS) == {"sample", "synthetic"}


def test_etl(spark, tmp_path):
    hosts = spark.createDataFrame([(1, "h", "x"), (1, "h", "y"), (2, "i", "z")], "host long, name string, room string")
    dim, rest = etl.normalize_by_key(hosts, "host", ["name"])
    assert dim.count() == 2 and rest.columns == ["host", "room"]
    links, people = spark.createDataFrame([(1, 1), (2, 2), (1, 2)], "person long, role int"), spark.createDataFrame([(1,), (2,), (3,)], "id long")
    out = etl.split_by_role(links, people, "role", {"actor": [1], "director": [2]}, "person", "id")
    assert rows(out["actor"][1]) == [(1,)] and rows(out["director"][1]) == [(1,), (2,)]
    assert etl.parameter_grid(a=[1, 2], b="x") == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    p, c = spark.createDataFrame([(1, "a"), (2, "b")], "pid long, a string"), spark.createDataFrame([(7, 1, "x"), (8, None, "y")], "cid long, parent_id long, b string")
    facts = etl.prepare(GRAPH, {"parent": p, "child": c}, str(tmp_path / "ready"))
    assert facts["child"]["null links"] == {"parent_id": 1} and facts["parent"]["tuple factors"][PC.tf]["without"] == 1


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert rows(aqp.AggregateQuery(("t",), "x").compute(df)) == [(0.0, None, None)]
    some = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", None)], "g string, x double")
    assert aqp.upscale(some, 12) == 4.0 and aqp.upscale(some, 2) == 1.0
    assert aqp.mean_or_share(some.withColumn(R.WEIGHT, F.lit(2.0)), "g", ["a"]).first()[0] == 1.0
    assert rows(aqp.AggregateQuery(("t",), "x", (), ("g",)).compute(some)) == [("a", 2.0, 1.0, 2.0)]
    one = spark.createDataFrame([(1, 0.5)], "k int, v double")
    assert rows(aqp.bounds(one, one.withColumn("v", F.lit(0.7)), one.withColumn("v", F.lit(0.9)), ["k"], "v")) == [(1, 0.7, 0.5, 0.9)]
    assert spark.range(1).select(*aqp.theoretical_bounds(F.lit(0.5), F.lit(0.8))).first()[:] == pytest.approx((0.4, 0.6))


def test_samples(spark):
    df = spark.range(2000)
    n = R.sample_with_replacement(df, "id", 3000, 1)
    assert abs(n.count() - 3000) < 300 and n.groupBy("id").count().agg(F.max("count")).first()[0] > 2
    many = R.sample_with_replacement(spark.range(3), "id", 6000, 1)
    assert abs(many.count() - 6000) < 500 and R.sample_with_replacement(df, "id", 0).count() == 0
    total = R.running_total(df.withColumn("a", F.lit(1)), "a", "id").filter("running != id + 1")
    assert total.count() == 0
    known = models.set_evidence(spark.createDataFrame([(1,), (2,)], "p long"), spark.createDataFrame([(5, 1, "x"), (6, 1, "y")], "c long, f long, v string"), "p", "f", "c", ["v"], 10)
    assert rows(known.select("p", "set_size")) == [(1, 2), (2, 0)]


def test_wide_columns_are_drawn_from_pieces(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(900)) * F.floor(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) / 2)).alias("v"))
    train = df.filter("g is null or g < 2 or id < 30")  # the context g = 2 has too little support
    model = models.CountModel.fit(train, "v", ["g"])
    assert model.values > models.WIDE
    draw = S.uniform(5, F.col("id"))
    whole = models.CountModel(model.column, model.levels, model.rows)
    want = rows(whole.sample(df.select("id", "g"), draw))
    assert len(want) == 6000 and rows(model.sample(df.select("id", "g"), draw)) == want
    assert rows(models.CountModel(model.column, model.levels, model.rows, model.values).sample(df.select("id", "g"), draw)) == want
    large = models.CountModel(model.column, model.levels, models.SMALL + 1, model.values, model.flat)
    assert rows(large.sample(df.select("id", "g"), draw)) == want
    # No draw meets the array of all the values of its context.
    none = [(own, t.withColumn("__cdf", F.when(F.rand() >= 0, F.raise_error(F.lit("the whole array"))).otherwise(F.col("__cdf")))) for own, t in model.levels]
    model.levels = none
    assert rows(model.sample(df.select("id", "g"), draw)) == want


def test_nearest_of_all_that_are_free(spark):
    rng = np.random.default_rng(4)
    for k in range(200):
        n, m, d = int(rng.integers(0, 12)), int(rng.integers(0, 12)), int(rng.integers(1, 3))
        t, c = (rng.integers(0, 6, (x, d)) / 3 if k % 2 else rng.normal(size=(x, d)) for x in (n, m))
        assert completion.nearest_free(t, c).tolist() == completion.greedy(t, c, max(1, n)).tolist()
    odd = completion.nearest_free(np.array([[0.0], [1.0], [2.0]]), np.array([[np.nan], [np.inf], [3.0]]))
    assert odd.tolist() == [2, 1, 0]
    # More rows of one block than a window once held; null blocks meet nothing.
    e = spark.range(600).select(F.col("id").alias("k"), F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("double").alias("x"))
    s = spark.range(900).select(F.col("id").alias("k"), F.lit("a").alias("g"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)).cast("double").alias("x"))
    null = spark.createDataFrame([(5000, None, 1.0)], "k long, g string, x double")
    m, sd = e.coalesce(1).agg(F.avg("x"), F.stddev_pop("x")).first()
    free, want = {r["k"]: (r["x"] - m) / sd for r in s.collect()}, []
    for k, x in sorted((r["k"], (r["x"] - m) / sd) for r in e.collect()):
        hit = min(free, key=lambda j: ((free[j] - x) * (free[j] - x), j))
        want.append((k, hit))
        del free[hit]
    assert sorted(map(tuple, completion.replace_nearest(s.unionByName(null), e.coalesce(1), "k", ["x"], ["g"]).collect())) == want
    assert completion.replace_nearest(s.unionByName(null), null, "k", ["x"], ["g"]).count() == 0


@pytest.mark.parametrize("features", [["x"], ["x", "y"]])
def test_replacement_in_cells_finds_a_partner_for_all(spark, monkeypatch, features):
    monkeypatch.setattr(completion, "EXACT_PAIRS", 4)
    monkeypatch.setattr(completion, "CELL", 16, raising=False)
    p = spark.range(1, 61).select(F.col("id").alias("pid"), F.lit(2).alias("tf_child_parent_id"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    for made, linked in ((100, 100), (120, 120), (150, 120)):
        df = spark.range(made).select((F.col("id") + 1000).alias("cid"), F.lit(None).cast("long").alias("parent_id"), (-1 - F.col("id")).alias("pid"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("y"), F.lit(7).alias("tf_child_parent_id"))
        got = completion.replace_parents(df, p, PC, "cid", features).toPandas()
        taken = got[got.pid > 0]
        assert len(got) == got.cid.nunique() == made and len(taken) == linked and taken.pid.value_counts().max() <= 2
        assert (taken.pid == taken.parent_id).all()


def test_cells_match_near_rows(spark):
    e = spark.range(1000).select("id", (F.col("id") / 10).alias("x"))
    s = spark.range(3000).select((F.col("id") + 7).alias("id"), (F.pmod(F.col("id") * 1237, F.lit(3000)) / 30).alias("x"))
    pairs = completion.replace_in_cells(s, e, "id", ["x"], 200).join(e.select(F.col("id").alias("existing"), "x"), "existing").join(s.select(F.col("id").alias("synthetic"), F.col("x").alias("z")), "synthetic")
    n, ones, others, far = pairs.agg(F.count("*"), F.count_distinct("existing"), F.count_distinct("synthetic"), F.max(F.abs(F.col("x") - F.col("z")))).first()
    assert n == ones == others == 1000 and far < 0.5


def test_strategies_share_their_validation(spark, monkeypatch):
    g = catalog.tpch_like().with_complete("nation", "events")
    table = lambda *x: spark.createDataFrame(list(enumerate(map(float, x))), "c_custkey long, c_acctbal double")
    s, more = (planner.Scenario(g, {"customer": df}, {}) for df in (table(8, 12), table(0, 0)))
    done, ran, run = {"nation": table(8, 10), "events": table(1, 3)}, [], []
    monkeypatch.setattr(planner, "validation", lambda s, r: (ran.append(r.kind), more)[1])
    monkeypatch.setattr(planner, "run_path", lambda s, path, columns: (run.append(path.start), done[path.start])[1])
    monkeypatch.setattr(planner.completion, "project_requested", lambda df, path, columns: df)
    bias = removal.Removal("customer", "bias", 0.5, "c_acctbal", 0.5)
    plans = planner.plans_selected(s, {"customer"}, list(planner.Selection), bias, "c_acctbal")
    assert [p.branches[0].start for p in plans[1:]] == ["nation"] * 4
    found = planner.candidates(g, {"customer"})
    assert ran == ["bias", "uniform"] and run == [p.start for p in found] * 2
    found = [next(p for p in found if p.start == start) for start in done]
    got = dict(zip([p.start for p in found], planner.scores(s, more, found, {"customer"}, "c_acctbal", key="c_custkey")))
    assert got == {"nation": (pytest.approx(0.9), 1.0), "events": (pytest.approx(0.2), 8.0)}
    assert planner.score(s, more, found[0], "c_acctbal") == (pytest.approx(got[found[0].start][0]), pytest.approx(got[found[0].start][1]))
