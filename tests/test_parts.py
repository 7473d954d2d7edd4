from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions.calendar import calendar, calendar_of
from cohortlake.functions.formula import INTERCEPT, design, split_formula, terms
from cohortlake.functions.stats import chi2_tail, z_quantile
from cohortlake.operators import inference, paneltools
from cohortlake.operators import panel as rules
from cohortlake.sources import loaders
from cohortlake.sources.simulate import effect_path, simulate_data
from cohortlake.streaming.moments import windowed_means

from .conftest import TOP


def test_tails():
    assert z_quantile(0.975) == pytest.approx(1.959963985)
    for x, df, want in ((3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (18.30703805, 10, 0.05), (0.5, 1, 0.4795001222), (200, 100, 1.2e-8), (0, 3, 1.0)):
        assert chi2_tail(x, df) == pytest.approx(want, rel=2e-2 if want < 1e-6 else 1e-7)
    assert chi2_tail(4.0, 2) == pytest.approx(math.exp(-2))


def test_formula_terms():
    assert split_formula("y") == ("y", "1") and split_formula("log(y) ~ a") == ("log(y)", "a")
    assert terms("a + b + a:b") == (True, [("a",), ("b",), ("a", "b")])
    assert terms("a * b") == (True, [("a",), ("b",), ("a", "b")])
    assert terms("a * b - a:b") == (True, [("a",), ("b",)])
    assert terms("0 + a") == (False, [("a",)]) and terms("a - 1") == (False, [("a",)])
    assert terms("1") == (True, []) and terms("I(a ** 2 + 1)") == (True, [("I(a ** 2 + 1)",)])


def test_design(spark):
    df = spark.createDataFrame([(1.0, 2.0, "u"), (2.0, 3.0, "v"), (3.0, 5.0, "w"), (4.0, 1.0, "u")], "a double, b double, c string")
    d = design(df, "a + c + a:c + I(b ** 2) + log(b)")
    assert d.names == [INTERCEPT, "a", "c[T.v]", "c[T.w]", "I(b ** 2)", "log(b)", "a:c[T.v]", "a:c[T.w]"]
    x = np.array([list(r) for r in df.select(*d.columns).collect()])
    assert x[1].tolist() == pytest.approx([1, 2, 1, 0, 9, math.log(3), 2, 0])
    assert design(df, "0 + c").names == ["c[u]", "c[v]", "c[w]"] and set(design(df, "a:c").used) == {"a", "c"}
    assert design(df, "a:c").names == [INTERCEPT, "a:c[u]", "a:c[v]", "a:c[w]"]


def test_too_many_levels_are_refused(spark):
    with pytest.raises(ValueError, match="levels"):
        design(spark.range(600).select(F.col("id").cast("string").alias("c")), "c")


def test_calendar_numbers_and_dates(spark):
    """Numbers and dates are each other's inverse on the calendar's steps; other times have no number."""
    for freq, step, n in (("D", "1 day", 40), ("W-MON", "7 days", 9), ("MS", "1 month", 14), ("H", "1 hour", 60), ("QS", "3 months", 6)):
        times = spark.sql(f"select explode(sequence(timestamp'2020-01-01', timestamp'2020-01-01' + interval {step} * {n}, interval {step})) as t") if "month" not in step else spark.sql(f"select explode(sequence(timestamp'2020-01-01', timestamp'2023-01-01', interval {step})) as t")
        steps = calendar_of(times, "t", freq)
        rows = times.select("t", steps.number(F.col("t")).alias("n"), steps.date(steps.number(F.col("t"))).alias("d"), steps.number(F.col("t") + F.expr("interval 7 minutes")).alias("no")).orderBy("t").collect()
        assert [r["n"] for r in rows] == list(range(1000, 1000 + len(rows))) and all(r["d"] == r["t"] and r["no"] is None for r in rows)
    work = spark.sql("select timestamp'2024-01-05' as t union all select timestamp'2024-01-08' union all select timestamp'2024-01-06'")  # a Friday, the Monday and the Saturday
    assert [r[0] for r in work.orderBy("t").select(calendar_of(work, "t", "B").number(F.col("t"))).collect()] == [1000, None, 1001]


def test_calendar(spark):
    df = spark.sql("select timestamp'2020-01-31' as t union all select timestamp'2020-04-30'")
    assert [r["number"] for r in calendar(df, "t", "M").orderBy("number").collect()] == [1000, 1001, 1002, 1003]
    assert [str(r["date"])[:10] for r in calendar(df, "t", "M").orderBy("number").collect()] == ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30"]
    assert [r["number"] for r in calendar(df, "t", "Y").collect()] == [2020]
    with pytest.raises(TypeError):
        calendar(df, "t", None)
    with pytest.raises(ValueError):
        calendar(df, "t", "fortnight")


def panel(spark, rows):
    return spark.createDataFrame(rows, "e string, t int, g double, y double")


def test_rules(spark):
    rows = [(e, t, g, float(t)) for e, g in (("always", 1.0), ("late", 9.0), ("in", 2.0), ("never", float("nan"))) for t in (1, 2, 3)]
    with pytest.warns(UserWarning):
        p = rules.prepare(panel(spark, rows), "e", "t", "g")
    assert p.is_panel and p.is_balanced and len(p.notes) == 2
    assert {(r["e"], r["g"]) for r in p.df.select("e", F.col(rules.G).alias("g")).distinct().collect()} == {("late", None), ("in", 2), ("never", None)}
    with pytest.warns(UserWarning):
        p = rules.prepare(panel(spark, [r for r in rows if r[0] == "in"] + [("x", t, 3.0, 1.0) for t in (1, 2, 3)]), "e", "t", "g")
    assert p.no_never_treated and {r[rules.T] for r in p.df.collect()} == {1, 2}


def test_rules_reject(spark):
    with pytest.raises(ValueError):
        rules.prepare(panel(spark, [("a", 1, 0.0, 1.0), ("a", 2, 0.0, 1.0), ("b", 1, 2.0, 1.0), ("b", 2, 2.0, 1.0)]), "e", "t", "g")
    with pytest.raises(ValueError):
        rules.prepare(panel(spark, [("a", 1, None, 1.0)]).withColumn("_w", F.lit(1)), "e", "t", "g")
    with pytest.raises(ValueError):
        rules.prepare(panel(spark, [("a", 1, None, 1.0)]).withColumn("t", F.current_timestamp()), "e", "t", "g", freq="D")


def test_separate_cohorts(spark):
    df = panel(spark, [(e, t, None, 1.0) for e in "abc" for t in (1, 2, 3)])
    given = spark.createDataFrame([("a", 2), ("b", 3)], "e string, g int")
    p = rules.prepare(df, "e", "t", "g", cohort_data=given)
    assert {(r["e"], r["g"]) for r in p.df.select("e", F.col(rules.G).alias("g")).distinct().collect()} == {("a", 2), ("b", 3), ("c", None)}
    with pytest.raises(ValueError):
        rules.prepare(df, "e", "t", "g", cohort_data=given.unionByName(given))


def test_time_varying_with_tolerance(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 1.0 + 1e-9, 2.0)], "e string, t int, u double, v double")
    assert rules.time_varying(df, "e", ["u", "v"]) == ["u", "v"]
    assert rules.time_varying(df, "e", ["u", "v"], rtol=1e-5, time="t") == ["v"]


def test_panel_tools(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 4, 4.0), ("b", 2, 2.0), ("b", 3, 3.0)], "e string, t int, y double")
    assert paneltools.has_gaps(df, "e", "t") and not paneltools.has_gaps(df.filter("e = 'b'"), "e", "t")
    assert sorted(map(tuple, paneltools.missing_times(df, "e", "t").collect())) == [("a", 2), ("a", 3)]
    assert paneltools.fill_gaps(df, "e", "t").filter("y is null").count() == 2
    assert paneltools.reindex_times(df, "e", "t", 1, 5, fill=0.0).count() == 10
    assert sorted(map(tuple, paneltools.entities_per_window(df, "e", "t", 2).collect())) == [(1, 2, 0), (2, 3, 1), (3, 4, 0)]
    assert [tuple(r) for r in paneltools.balanced_windows(df, "e", "t", 2).collect()] == [(2, 3, 1)]
    assert paneltools.fully_observed(df, "e", "t").count() == 4
    events = spark.createDataFrame([("a", 2, 0.5), ("a", 3, 2.0), ("b", 3, 1.0)], "e string, cohort int, size double")
    assert sorted(map(tuple, paneltools.cohort_table(events, "e", "size").collect())) == [("a", 0.5, 2.0), ("b", 1.0, None)]
    dummies = paneltools.relative_dummies(df, events, "e", "t", -1, 1, "size")
    got = {(r["e"], r["t"]): tuple(r)[2:] for r in dummies.collect()}
    assert got["a", 1] == (0.5, 0, 0) and got["a", 4] == (0, 0, 2.0) and got["b", 3] == (0, 1.0, 0)
    with pytest.raises(ValueError):
        paneltools.relative_dummies(df, events, "e", "t", 2, 1)


def test_bootstrap_follows_its_definition(spark):
    import hashlib

    rng = np.random.default_rng(0)
    psi = rng.normal(size=(30, 2))
    df = spark.createDataFrame([(k, f"u{i}", float(psi[i, k])) for i in range(30) for k in range(2)], "agg_id int, unit string, psi double")
    got = {(r["draw"], r["agg_id"]): r["value"] for r in inference.bootstrap(df, "agg_id", 300, 7, 30).collect()}
    for b in range(1, 301):
        digest = [int(hashlib.md5(f"u{i}|{(b - 1) // 128}|7".encode()).hexdigest(), 16) for i in range(30)]
        s = np.array([1 if x >> (127 - (b - 1) % 128) & 1 else -1 for x in digest])
        for k in range(2):
            assert got[b, k] == pytest.approx(np.sqrt(30) * np.mean(s * psi[:, k]))


def test_clusters_count_all_their_units(spark):
    psi = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0)], "agg_id int, unit string, psi double")
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 2)], "unit string, cluster int")
    found, n = inference.clustered(psi, ["agg_id"], groups)
    assert n == 2 and [(r["unit"], r["psi"]) for r in found.collect()] == [(1, 1.0)]


def test_simulation(spark):
    one, two = simulate_data(spark, nentity=50, seed=9), simulate_data(spark, nentity=50, seed=9).repartition(7)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 400
    assert simulate_data(spark, nentity=50, unbalance=True).count() < 400
    wide = simulate_data(spark, nentity=60, samples=3, intensity_by=2, missing=0.2, const=True, datetime=True)
    assert {"strata", "samples", "const"} <= set(wide.columns) and wide.schema["time"].dataType.simpleString() == "timestamp"
    assert wide.filter("x0 is null").count() > 0 and wide.select("samples").distinct().count() == 3
    with pytest.raises(ValueError):
        simulate_data(spark, cohort_shares=[0.5, 0.4, 0.2])
    with pytest.raises(ValueError):
        simulate_data(spark, intensity_by="other")
    some = simulate_data(spark, nentity=400, cohort_shares=[0.5, 0.2], share_treated=1.0).select("entity", "cohort").distinct().groupBy("cohort").count().collect()
    assert len(some) == 2 and max(r["count"] for r in some) < 260  # as many cohorts as shares, and the last takes what is left
    assert "intensity" not in simulate_data(spark, intensity_by=None).columns
    several = simulate_data(spark, nentity=300, intensity_by=(2, 3, "cohort"), random_func=None).filter("cohort is not null")
    groups = several.select("strata", "strata1", "cohort", F.round("intensity", 6).alias("i")).distinct()
    assert groups.count() == 18 == groups.select("i").distinct().count() and groups.agg(F.min("i"), F.max("i")).first() == (0.5, 10.0)
    assert simulate_data(spark, nentity=30, positive_effect=False).filter("effect <> 0").count() == 0


def test_effect_path(spark):
    """Against the definition, written out for numbers."""

    def plain(k, tau, alpha, bound):
        if k <= 0 or not tau:
            return float(k > 0)
        ramp = min(k / tau, 1) if bound else k / tau
        return ramp - (min((k - tau) / tau, 1) / alpha if alpha and k > tau else 0)

    df = spark.range(-4, 12).select(F.col("id").cast("double").alias("k"))
    for tau, alpha, bound in ((1, 0, True), (4, 0, True), (4, 0, False), (3, 2, True), (3, 2, False), (0, 0, True), (0, 3, False)):
        for k, got in df.select("k", effect_path(F.col("k"), tau, alpha, True, bound)).collect():
            assert got == pytest.approx(plain(k, tau, alpha, bound)), (k, tau, alpha, bound)


def test_loaders(spark, tmp_path):
    spark.createDataFrame([(1, 2003, 0, 5.0, 1.0), (2, 2003, 2004, 6.0, 2.0)], "countyreal int, year int, first_treat int, lemp double, lpop double").write.parquet(f"{tmp_path}/m")
    got = loaders.mpdta(spark, f"{tmp_path}/m")
    assert [r["first_treat"] for r in got["data"].orderBy("countyreal").collect()] == [None, 2004] and got["cohort_name"] == "first_treat"
    (tmp_path / "two.csv").write_text("id,d,post,y\n1,1,1,2.5\n2,0,0,1.5\n")
    rows = loaders.rc_two_periods(spark, f"{tmp_path}/two.csv")["data"].orderBy("id").collect()
    assert [(r["time"], r["cohort"]) for r in rows] == [(2000, 2000), (1999, None)]
    (tmp_path / "rc.csv").write_text("id,period,G,Y\n1,1,0,2.5\n2,2,2,1.5\n")
    assert [r["G"] for r in loaders.rc_multi_period(spark, f"{tmp_path}/rc.csv")["data"].orderBy("id").collect()] == [None, 2]
    (tmp_path / "p.csv").write_text(
        "I,T,y,cohort,event_size\n1,2000-01-01,1,2001-01-01,3.5\n1,2001-01-01,2,2001-01-01,3.5\n2,2000-01-01,1,,\n3,2000-01-01,1,2002-01-01,1.5\n4,2000-01-01,1,2003-01-01,9\n"
    )
    merged = loaders.simulated_data(spark, f"{tmp_path}/p.csv")["data"]
    assert [r["qevent_size"] for r in merged.orderBy("I", "T").collect()] == [1, 1, None, 0, 2]
    apart = loaders.simulated_data(spark, f"{tmp_path}/p.csv", separate=True)
    assert apart["cohort_data"].count() == 4 and not {"cohort", "event_size"} & set(apart["data"].columns)
    assert apart["cohort_data"].columns == ["I", "cohort", "event_size", "qevent_size"]


def test_streamed_means_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = windowed_means(stream, "user_id", "ts", "value", late="60 days").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    pick = lambda df: sorted((r["user_id"], r["time"], r["n"], round(r["y"], 8)) for r in df.collect())
    assert pick(spark.table("means")) == pick(windowed_means(events, "user_id", "ts", "value")) != []


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, also):
    """With both folders gone, and the pipeline left or gone; nothing of this repository is on the Python path."""
    shutil.copytree(TOP, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not Path(p, "__spark_entry__.py").exists())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["True", "False", "False"], out.stderr


def test_nothing_imports_the_training_data_operators():
    assert not any("cohortlake.llm" in (text := p.read_text()) or "import llm" in text for p in Path(TOP, "cohortlake").glob("**/*.py") if "llm" not in p.parts)
