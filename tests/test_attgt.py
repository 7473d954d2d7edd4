from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlake.plans.attgt import ATTgt
from cohortlake.sources.simulate import simulate_data

from . import plain

METHODS = ["reg", "dr", "dr-ipt", "std_ipw", "ipw"]


@pytest.fixture(scope="module")
def data(spark):
    df = simulate_data(spark, nentity=160, ntime=6, nexog=2, seed=3).withColumn("c", F.round(F.col("x0")).cast("int") % 2)
    return spark.createDataFrame(df.toPandas().astype({"cohort": "Int64"}).astype(object).where(lambda p: p.notna(), None), df.schema)


def frame(data):
    out = data.toPandas()
    out["cohort"] = out["cohort"].astype(float)
    return out


def cell_rows(pdf, g, base, t, control="never"):
    d = pdf["cohort"] == g
    c = pdf["cohort"].isna()
    if control != "never":
        c |= ~d & (pdf["cohort"] > max(t, base))
    return pdf[pdf["time"].isin([base, t]) & (d | c)].assign(d=d.astype(float))


def design(pdf, names):
    return np.column_stack([np.ones(len(pdf)), *(pdf[n] for n in names)])


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("weights", [None, "weights"])
def test_panel_against_plain(data, method, weights):
    pdf = frame(data)
    n = pdf["entity"].nunique()
    model = ATTgt(data, "cohort")
    got = model.fit("y ~ x0 + x1", est_method=method, weights_name=weights).collect()
    assert len(got) >= 10
    for r in got:
        rows = cell_rows(pdf, r["cohort"], r["base_period"], r["time"]).set_index("entity")
        a, b = rows[rows["time"] == r["base_period"]], rows[rows["time"] == r["time"]]
        b = b.loc[a.index]
        early = a if r["base_period"] < r["time"] else b
        w = early[weights].to_numpy() if weights else np.ones(len(a))
        att, psi = plain.panel(method, (b["y"] - a["y"]).to_numpy(), design(early, ["x0", "x1"]), a["d"].to_numpy(), w)
        assert r["ATT"] == pytest.approx(att, rel=1e-7)
        assert r["std_error"] == pytest.approx(np.sqrt(np.sum((psi * n / len(a)) ** 2)) / n, rel=1e-6)
        assert abs(psi.mean()) < 1e-8 and r["n_sample"] == len(a) and r["n_total"] == n
    model.close()


@pytest.mark.parametrize("method", METHODS)
def test_cross_section_against_plain(data, method):
    rows_ = data.withColumn("id", F.monotonically_increasing_id())
    pdf = frame(rows_)
    model = ATTgt(rows_, "cohort", entity_name="id", time_name="time")
    assert not model.is_panel
    for r in model.fit("y ~ x0", est_method=method, weights_name="weights", control_group="not_yet_treated").collect():
        rows = cell_rows(pdf, r["cohort"], r["base_period"], r["time"], "not")
        t = (rows["time"] == r["time"]).to_numpy().astype(float)
        att, psi = plain.cross(method, rows["y"].to_numpy(), design(rows, ["x0"]), rows["d"].to_numpy(), rows["weights"].to_numpy(), t)
        assert r["ATT"] == pytest.approx(att, rel=1e-7)
        assert r["std_error"] == pytest.approx(np.sqrt(np.sum((psi * len(pdf) / len(rows)) ** 2)) / len(pdf), rel=1e-6)
    model.close()


def test_many_covariates_sum_matrices(data, monkeypatch):
    model = ATTgt(data, "cohort")
    want = {tuple(r)[:8]: r["std_error"] for r in model.fit("y ~ x0 + x1", est_method="dr").select("cohort", "time", F.round("ATT", 7), F.round("std_error", 7).alias("std_error")).collect()}
    monkeypatch.setattr("cohortlake.operators.estimators.WIDE", 1)
    got = {tuple(r)[:8]: r["std_error"] for r in model.fit("y ~ x0 + x1", est_method="dr").select("cohort", "time", F.round("ATT", 7), F.round("std_error", 7).alias("std_error")).collect()}
    assert got == want


@pytest.mark.parametrize("method", ["dr", "dr-ipt"])
def test_discrete_covariates_are_fitted_from_their_distinct_rows(data, method, monkeypatch):
    """On the driver from few distinct rows, or by aggregates over all rows: the same coefficients, on panels and cross-sections."""
    for cross in (False, True):
        pick = lambda: sorted((r["cohort"], r["time"], round(r["ATT"], 7), round(r["std_error"], 7)) for r in ATTgt(data, "cohort").fit("y ~ C(c)", est_method=method, as_repeated_cross_section=cross).collect())  # noqa: E731, B023
        want = pick()
        with monkeypatch.context() as m:
            m.setattr("cohortlake.operators.estimators.FEW", -1)
            assert pick() == want and want


def test_methods_agree_without_covariates(data):
    found = []
    for m in METHODS:
        found.append([(r[0], r[1], round(r[2], 8), round(r[3], 8)) for r in ATTgt(data, "cohort").fit("y", est_method=m).orderBy("cohort", "time").select("cohort", "time", "ATT", "std_error").collect()])
    assert all(f == found[0] for f in found)


def test_universal_base_shares_post_cells(data):
    a = ATTgt(data, "cohort").fit("y", est_method="reg")
    b = ATTgt(data, "cohort", base_period="universal").fit("y", est_method="reg")
    post = lambda df: sorted((r["cohort"], r["time"], round(r["ATT"], 8)) for r in df.filter("time >= cohort").collect())
    assert post(a) == post(b)
    (ref,) = b.filter("cohort = (select 1903) and time = base_period").collect() or b.filter("time = base_period").limit(1).collect()
    assert ref["ATT"] == 0 and ref["std_error"] is None and ref["zero_not_in_cband"] == ""


def test_simulated_effects_are_found(spark):
    """Without noise beyond the standard normal, event effects grow as they were made."""
    df = simulate_data(spark, nentity=800, ntime=8, intensity_by="entity", low=1.0, high=1.0001, effect_size=10, tau=10, seed=1)
    model = ATTgt(df, "cohort")
    model.fit("y ~ x0", est_method="dr")
    for r in model.aggregate("event").collect():
        want = max(r["relative_period"], 0)
        assert abs(r["ATT"] - want) < 5 * r["std_error"] + 1e-3


def test_callable_and_named_splits_agree(data):
    odd = data.withColumn("part", (F.length("entity") % 2).cast("int"))
    by_name, by_call = ATTgt(odd, "cohort"), ATTgt(odd, "cohort")
    by_name.fit("y", est_method="reg", split_sample_by="part")
    by_call.fit("y", est_method="reg", split_sample_by=lambda df: F.col("part") == 1)
    assert by_name.sample_names == ["part = 0", "part = 1"] and len(by_call.sample_names) == 2
    a = sorted(round(r["ATT"], 8) for r in by_name.aggregate("simple").collect())
    assert a == sorted(round(r["ATT"], 8) for r in by_call.aggregate("simple").collect())


def test_failed_cells_keep_their_reason(data):
    lonely = data.withColumn("y", F.when((F.col("cohort").isNull()) | (F.col("time") != 1902), F.col("y")))
    got = ATTgt(lonely, "cohort").fit("y", est_method="reg", as_repeated_cross_section=False).collect()
    failed = [r for r in got if r["ATT"] is None]
    assert failed and all(r["exception"] for r in failed) and any(r["ATT"] is not None for r in got)


def test_missing_rows_fall_out(data):
    holes = data.withColumn("x0", F.when(F.crc32(F.col("entity").cast("binary")) % 7 == 0, float("nan")).otherwise(F.col("x0")))
    got = ATTgt(holes, "cohort").fit("y ~ x0", est_method="reg")
    kept = data.filter(F.crc32(F.col("entity").cast("binary")) % 7 != 0)
    want = ATTgt(kept, "cohort").fit("y ~ x0", est_method="reg")
    pick = lambda df: [(r["cohort"], r["time"], round(r["ATT"], 8)) for r in df.orderBy("cohort", "time").collect()]
    assert pick(got) == pick(want)


def test_arguments(data):
    with pytest.raises(ValueError):
        ATTgt(data, "cohort", base_period="other")
    with pytest.raises(ValueError):
        ATTgt(data, "cohort", anticipation=-1)
    model = ATTgt(data, "cohort")
    with pytest.raises(RuntimeError):
        model.aggregate("simple")
    for bad in ({"control_group": "some"}, {"est_method": "magic"}, {"boot_iterations": -1}, {"base_delta": {"base": ["nope"]}}, {"base_delta": "nope"}):
        with pytest.raises(ValueError):
            model.fit("y ~ x0", **bad)
    treated = data.filter("cohort is not null")
    with pytest.warns(UserWarning):
        only = ATTgt(treated, "cohort")
    with pytest.raises(ValueError):
        only.fit("y")
    assert only.fit("y", control_group="not_yet", est_method="reg").filter("ATT is not null").count() > 0


def test_base_delta(data):
    pdf = frame(data)
    model = ATTgt(data, "cohort")
    for r in model.fit("y ~ x0 + x1", est_method="reg", base_delta={"base": ["x1"], "delta": ["x0"]}).limit(4).collect():
        rows = cell_rows(pdf, r["cohort"], r["base_period"], r["time"]).set_index("entity")
        a, b = rows[rows["time"] == r["base_period"]], rows[rows["time"] == r["time"]]
        b = b.loc[a.index]
        x = np.column_stack([np.ones(len(a)), a["x1"], b["x0"] - a["x0"]])
        assert r["ATT"] == pytest.approx(plain.panel("reg", (b["y"] - a["y"]).to_numpy(), x, a["d"].to_numpy(), np.ones(len(a)))[0])
    assert model.estimation_details()["base_delta"] == {"base": ["Intercept", "x1"], "delta": ["x0"]}


def test_contrasts_of_samples(data):
    odd = data.withColumn("part", (F.length("entity") % 2).cast("int"))
    model = ATTgt(odd, "cohort")
    model.fit("y", est_method="reg", split_sample_by="part")
    parts = {(r["sample_name"], r["relative_period"]): r for r in model.aggregate("event").collect()}
    plain_, scaled = model.aggregate("event", difference=True), model.aggregate("event", difference=True, rescale=True)
    for r, s in zip(plain_.orderBy("relative_period").collect(), scaled.orderBy("relative_period").collect()):
        a, b = parts["part = 0", r["relative_period"]], parts["part = 1", r["relative_period"]]
        assert r["ATT"] == pytest.approx(a["ATT"] - b["ATT"]) and r["difference_between"] == "part = 0 - part = 1"
        assert s["std_error"] == pytest.approx(np.hypot(a["std_error"], b["std_error"])) and s["std_error"] > r["std_error"]
    for bad in (["part = 0", "nope"], {"other": [1, 2]}, {"samples": ["part = 0"]}):
        with pytest.raises(ValueError):
            model.aggregate("event", difference=bad)


def test_strata(spark):
    df = simulate_data(spark, nentity=400, intensity_by=2, seed=2)
    model = ATTgt(df, "cohort", strata_name="strata")
    model.fit("y", est_method="reg")
    found = {r["stratum"]: r["ATT"] for r in model.aggregate("simple").collect()}
    assert set(found) == {0, 1}
    (r,) = model.aggregate("simple", difference=[0, 1]).collect()
    assert r["ATT"] == pytest.approx(found[0] - found[1])
    (r,) = model.aggregate("simple", difference=[0, 1], boot_iterations=40, random_state=0).collect()
    assert r["se_kind"] == "bootstrap" and r["std_error"] > 0


def test_results_and_caching(data):
    model = ATTgt(data, "cohort")
    model.fit("y", est_method="reg")
    event = model.aggregate("event")
    assert model.aggregate("event") is event
    assert set(model.results(add_info=True).select("post").distinct().toPandas()["post"]) == {"pre", "post"}
    assert isinstance(model.results("simple", to_dataframe=False), list)
    test = model.wald_pre_test()
    assert 0 <= test["p_value"] <= 1 and test["df"] > 0
    assert model.estimation_details()["control_group"] == "never_treated"
    with pytest.raises(ValueError):
        model.fit("y", filter_cells={"cohort": [1]}) and model.aggregate("nonsense", difference=True)


def test_two_samples_and_two_strata_must_be_named(spark):
    df = simulate_data(spark, nentity=200, intensity_by=2, seed=2).withColumn("part", F.length("entity") % 2)
    model = ATTgt(df, "cohort", strata_name="strata")
    model.fit("y", est_method="reg", split_sample_by="part")
    with pytest.raises(ValueError, match="name them"):
        model.aggregate("event", difference=True)


def test_results_only(data):
    model = ATTgt(data, "cohort")
    every = model.fit("y", est_method="reg").collect()
    some = model.results(only={"pre": True, "influence": True, "time": (1903, None)}).collect()
    assert some and {(r["cohort"], r["time"]) for r in some} == {(r["cohort"], r["time"]) for r in every if r["ATT"] is not None and 1903 <= r["time"] < r["cohort"] and r["std_error"]}


def test_results_give_back_what_their_model_kept(data, spark):
    import gc

    gc.collect()
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    model = ATTgt(data.withColumn("y", F.col("y") + 1), "cohort")
    out = model.fit("y", est_method="dr")
    assert out.count() and len(spark.sparkContext._jsc.getPersistentRDDs()) > before
    del model
    assert out.count()
    del out
    gc.collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_only_some_cells(data):
    model = ATTgt(data, "cohort")
    got = model.fit("y", est_method="reg", filter_cells={"time": (1902, 1903)}).collect()
    assert got and {r["time"] for r in got} == {1902, 1903}
