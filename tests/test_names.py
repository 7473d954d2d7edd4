"""Columns of the caller may have any name that is not reserved."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlake.plans.attgt import ATTgt
from cohortlake.sources.simulate import simulate_data

NAMES = ["unit", "t", "g", "s", "x", "w", "d", "y", "at", "obs", "sample", "cluster", "cell_id", "time", "stratum"]


@pytest.fixture(scope="module")
def data(spark):
    df = simulate_data(spark, nentity=80, ntime=5, seed=4).select("entity", F.col("time").alias("year"), F.col("cohort").alias("first"), F.col("y").alias("out"), "x0", "weights", (F.length("entity") % 2).alias("part"))
    return spark.createDataFrame(df.collect(), df.schema)


def found(df, out="out", x="x0", w="weights", part="part", entity="entity", year="year", first="first", split=None):
    model = ATTgt(df, first, entity_name=entity, time_name=year, strata_name=None if split else part)
    got = model.fit(f"{out} ~ {x}", est_method="reg", weights_name=w, split_sample_by=split)
    rows = sorted((tuple(round(v, 8) if isinstance(v, float) else str(v) for v in r) for r in got.select("cohort", "time", "ATT", "std_error", "n_sample").collect()), key=str)
    model.close()
    return rows


@pytest.mark.parametrize("role", ["out", "x", "w", "part", "entity", "year", "first"])
def test_names_of_each_role(data, role):
    old = {"out": "out", "x": "x0", "w": "weights", "part": "part", "entity": "entity", "year": "year", "first": "first"}[role]
    want = found(data)
    for name in ("unit", "t", "g", "cluster", "sample"):
        assert found(data.withColumnRenamed(old, name), **{role: name}) == want


def test_further_columns_of_all_names(data):
    more = data.withColumns({n: F.lit("other") for n in NAMES})
    assert found(more) == found(data)
    assert found(more.drop("sample").withColumn("sample", F.col("part")), split="sample") == found(data, split="part")


def test_reserved_names_are_refused(data):
    with pytest.raises(ValueError, match="reserved"):
        ATTgt(data.withColumn("_T", F.lit(1)), "first", entity_name="entity", time_name="year")


@pytest.mark.parametrize("control", ["never_treated", "not_yet_treated"])
@pytest.mark.parametrize("strata", [None, "part"])
def test_units_meet_cells_by_equality(data, control, strata):
    """No plan compares all units with all cells."""
    model = ATTgt(data, "first", strata, entity_name="entity", time_name="year")
    got = model.fit("out", control_group=control, est_method="reg")
    plan = got._jdf.queryExecution().executedPlan().toString() + model.psi._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Cross" not in plan
    assert got.filter("ATT is not null").count()
    model.close()
