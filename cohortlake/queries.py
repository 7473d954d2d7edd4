"""A query for each operator, on panels made of the test tables, with SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql
from .functions.calendar import calendar_of
from .operators import cells as planning
from .operators import panel as rules
from .operators import paneltools as tools
from .plans.attgt import ATTgt
from .sources.simulate import simulate_data
from .streaming.moments import windowed_means

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort_of(key: str) -> Column:
    return F.when(F.col(key) % 4 != 0, (1996 + F.col(key) % 4).cast("int"))


def _div(key: str, by: int) -> Column:
    return F.floor(F.col(key) / by).cast("int")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Balanced: supplier by year."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("e"), F.year("l_shipdate").alias("t"))
    out = rows.agg(F.avg("l_extendedprice").cast("double").alias("y"), F.avg("l_quantity").cast("double").alias("q"))
    return out.withColumns({"g": cohort_of("e"), "s": _div("e", 4) % 2, "x": _div("e", 8) % 2, "w": (1 + (F.col("e") % 5) / 10).cast("double")}).withColumnRenamed("t", "year").select("e", "year", "g", "y", "q", "s", "x", "w")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Unbalanced: customer by year."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("year"))
    return rows.agg(F.avg("o_totalprice").cast("double").alias("y")).withColumns({"g": cohort_of("e"), "x": _div("e", 8) % 2})


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Repeated cross-section: one row for each order, cohorts by the customer's nation."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("e"), F.year("o_orderdate").alias("year"), cohort_of("c_nationkey").alias("g"), F.col("o_totalprice").cast("double").alias("y"), (_div("o_custkey", 8) % 2).alias("x"))


def weeks(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps: user by week; the cohort is the Monday of week 2, 3 or 4, or never."""
    monday = F.date_trunc("week", F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("e"), monday.alias("week")).agg(F.avg("value").cast("double").alias("y"))
    start = F.lit("2024-01-01").cast("timestamp")
    return rows.withColumn("g", F.when(F.col("e") % 4 > 0, start + F.make_dt_interval((F.col("e") % 4 * 7).cast("int"))))


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"year": "t"})


def _spans(df: DataFrame) -> DataFrame:
    return rules.with_spans(df.withColumns({rules.UNIT: F.col("e"), rules.T: F.col("year"), rules.G: F.col("g")}))


def _ruled(df: DataFrame) -> DataFrame:
    """The caller's columns with the rules' times and cohorts in place of its own."""
    return df.withColumns({"t": F.col(rules.T), "g": F.col(rules.G)})


def _of(result: DataFrame, out: DataFrame) -> DataFrame:
    """out, which keeps the model of the result it is made of."""
    out._model = getattr(result, "_model", None)
    return out


def _effects(df: DataFrame, *keys: str) -> DataFrame:
    return _of(df, df.select(*keys, F.round("ATT", 4).alias("att"), F.round("std_error", 4).alias("std_error")))


CELL = ("cohort", "base_period", "time")
#: In results that are compared across engines, never treated reads 0: drivers disagree on the type of integers with nulls.
NEVER = "coalesce(g, 0) AS g"

# -- planning


def _cells(found: DataFrame) -> DataFrame:
    return found.select(F.col("cohort").cast("int"), F.col("base_period").cast("int"), F.col("time").cast("int"))


_CELLS = "SELECT cg AS cohort, base AS base_period, tt AS time FROM cells"
query("cells_varying", sql.build(sql.F1, sql.PLAIN, sql.cells(), out=_CELLS))(lambda s, d: _cells(planning.varying(_canonical(suppliers(s, d)))))
query("cells_universal", sql.build(sql.F1, sql.PLAIN, sql.cells(0, True), out=_CELLS))(lambda s, d: _cells(planning.universal(_canonical(suppliers(s, d)))))
query("cells_anticipation", sql.build(sql.F1, sql.PLAIN, sql.cells(1), out=_CELLS))(lambda s, d: _cells(planning.varying(_canonical(suppliers(s, d)), 1)))


@query(
    "cells_feasible",
    sql.build(sql.F2, sql.RULES + ", p2 AS (SELECT * FROM p WHERE NOT (g = 1998 AND t = 1999))", sql.cells(), out=f"{_CELLS} WHERE base = tt OR ((cg, tt) IN (SELECT g, t FROM p2) AND (cg, base) IN (SELECT g, t FROM p2))"),
)
def cells_feasible(spark: SparkSession, d: str) -> DataFrame:
    df = _ruled(rules.treated_after_to_never(rules.drop_always_treated(_spans(customers(spark, d)))))
    seen = df.filter("g is null or not (g = 1998 and t = 1999)")
    return _cells(planning.feasible(planning.varying(df), seen))


@query("cells_by_stratum", sql.build(sql.F1, sql.PLAIN, sql.cells(), out="SELECT cg AS cohort, base AS base_period, tt AS time, s AS stratum FROM cells CROSS JOIN (SELECT DISTINCT s FROM p)"))
def cells_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    df = _canonical(suppliers(spark, d))
    return planning.by_stratum(planning.varying(df), df, "s").select(*CELL, F.col("stratum").cast("int"))


@query("cells_filtered", sql.build(sql.F1, sql.PLAIN, sql.cells(), out=f"{_CELLS} WHERE cg IN (1997, 1999) AND tt - cg BETWEEN -1 AND 2 AND tt >= cg"))
def cells_filtered(spark: SparkSession, d: str) -> DataFrame:
    return planning.post_treatment(planning.chosen(_cells(planning.varying(_canonical(suppliers(spark, d)))), cohort=[1997, 1999], relative_period=(-1, 2)))


# -- preprocessing

_SPANS = "spans AS (SELECT *, max(g) OVER (PARTITION BY e) AS gg, min(t) OVER (PARTITION BY e) AS a, max(t) OVER (PARTITION BY e) AS b FROM p0)"


@query("drop_always_treated", sql.build(sql.F2, _SPANS, out="SELECT e, t, coalesce(g, 0)::INT AS g, round(y, 4) AS y FROM spans WHERE gg IS NULL OR gg > a"))
def drop_always_treated(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(rules.drop_always_treated(_spans(customers(spark, d)))).selectExpr("e", "t", NEVER, "round(y, 4) AS y")


@query("treated_after_to_never", sql.build(sql.F2, _SPANS, out="SELECT e, t, coalesce(CASE WHEN gg <= b THEN gg END, 0)::INT AS g FROM spans"))
def treated_after(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(rules.treated_after_to_never(_spans(customers(spark, d)))).selectExpr("e", "t", NEVER)


@query("no_never_treated", sql.build(sql.F1, out="SELECT e, t, coalesce(CASE WHEN g <> 1999 THEN g END, 0)::INT AS g FROM p0 WHERE g IS NOT NULL AND t < 1999"))
def no_never_treated(spark: SparkSession, d: str) -> DataFrame:
    found = rules.prepare(suppliers(spark, d).filter("g is not null"), "e", "year", "g", warn=False)
    return _ruled(found.df).selectExpr("e", "t", NEVER)


@query("balance_check", f"WITH {sql.F1}, {sql.F2.replace('p0 AS', 'p2 AS')} SELECT 'customers' AS panel, min(n) = max(n) AS balanced FROM (SELECT count(*) AS n FROM p2 GROUP BY t) UNION ALL SELECT 'suppliers', min(n) = max(n) FROM (SELECT count(*) AS n FROM p0 GROUP BY t)")
def balance_check(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f.__name__, rules.is_balanced(f(spark, d), "year")) for f in (suppliers, customers)], "panel string, balanced boolean")


@query("time_varying_covars", f"WITH {sql.F1} SELECT c AS name FROM (SELECT unnest(['q', 's', 'x', 'w']) AS c, unnest([max(a), max(b), max(f), max(h)]) AS n FROM (SELECT count(DISTINCT q) AS a, count(DISTINCT s) AS b, count(DISTINCT x) AS f, count(DISTINCT w) AS h FROM p0 GROUP BY e)) WHERE n > 1")
def time_varying_covars(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in rules.time_varying(suppliers(spark, d), "e", ["q", "s", "x", "w"])], "name string")


@query("calendar_map", "SELECT DISTINCT user_id AS e, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, (1000 + date_diff('day', (SELECT min(date_trunc('week', ts)) FROM events), date_trunc('week', ts)) // 7)::INT AS number FROM events")
def calendar_map(spark: SparkSession, d: str) -> DataFrame:
    df = weeks(spark, d)
    number = calendar_of(df, "week", "W-MON").number(F.col("week"))
    return df.select("e", F.date_format("week", "yyyy-MM-dd").alias("week"), number.cast("int").alias("number"))


# -- estimators


def _panel_query(name: str, oracle: str, formula: str = "y", source: Callable = suppliers, keys: tuple[str, ...] = CELL, base: dict | None = None, **fit: object) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _effects(ATTgt(source(spark, d), "g", entity_name="e", time_name="year", **(base or {})).fit(formula, **fit), *keys)


_panel_query("attgt_uncond", sql.panel(), est_method="reg")
_panel_query("attgt_universal", sql.universal(), est_method="reg", base={"base_period": "universal"})
_panel_query("attgt_notyet", sql.panel(kind="notyet"), control_group="not_yet_treated", est_method="reg")
_panel_query("attgt_anticipation", sql.panel(kind="notyet", anticipation=1), control_group="not_yet_treated", est_method="reg", base={"anticipation": 1})
_panel_query("attgt_reg_x", sql.regression(), "y ~ q", est_method="reg")
_panel_query("attgt_dr_mle", sql.panel(saturated=True), "y ~ x", est_method="dr")
_panel_query("attgt_dr_ipt", sql.panel(saturated=True), "y ~ x", est_method="dr-ipt")
_panel_query("attgt_std_ipw", sql.panel(saturated=True), "y ~ C(x)", est_method="std_ipw")
_panel_query("attgt_ipw", sql.panel(saturated=True), "y ~ x", est_method="ipw")
_panel_query("attgt_continuous", sql.continuous(), "y ~ q", est_method="std_ipw")
_panel_query("attgt_name_unit", sql.regression(), "y ~ unit", source=lambda s, d: suppliers(s, d).withColumnsRenamed({"q": "unit", "s": "t"}), est_method="reg")
_panel_query("attgt_weighted", sql.panel(saturated=True, weighted=True), "y ~ x", est_method="dr", weights_name="w")
_panel_query("attgt_delta", sql.delta(), "y ~ q", est_method="reg", base_delta="delta")
for _m, _n in (("reg", "reg"), ("dr", "dr"), ("dr-ipt", "dr_ipt"), ("std_ipw", "std_ipw"), ("ipw", "ipw")):
    _panel_query(f"attgt_rc_{_n}", sql.cross(_m), "y ~ x", source=orders, est_method=_m)
_panel_query("attgt_unbalanced_2x2", sql.panel(sql.F2, sql.RULES), source=customers, est_method="reg", as_repeated_cross_section=False)
_panel_query("attgt_unbalanced_rc", sql.cross("reg", sql.F2, sql.RULES, saturated=False, by_unit=True), source=customers, est_method="reg")

# -- aggregation


def _aggregate_query(name: str, oracle: str | None, kind: str | None, keys: tuple[str, ...] = (), overall: bool = False, fit: dict | None = None, strata: bool = False, **how: object) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, d: str) -> DataFrame:
        model = ATTgt(suppliers(spark, d), "g", strata_name="s" if strata else None, entity_name="e", time_name="year")
        model.fit(**{"formula": "y", "est_method": "reg", **(fit or {})})
        return _effects(model.aggregate(kind, overall, **how), *keys)


for _kind, _key in (("simple", ()), ("event", ("relative_period",)), ("cohort", ("cohort",)), ("time", ("time",))):
    _aggregate_query(f"agg_{_kind}", sql.aggregated(_kind), _kind, _key)
    if _kind != "simple":
        _aggregate_query(f"agg_{_kind}_overall", sql.aggregated(_kind, True), _kind, (), True)

# -- heterogeneity


@query("split_event", sql.aggregated("event", key="a.s", label="'s = ' || i AS sample_name, "))
def split_event(spark: SparkSession, d: str) -> DataFrame:
    model = ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year")
    model.fit("y", est_method="reg", split_sample_by="s")
    return _effects(model.aggregate("event"), "sample_name", "relative_period")


_aggregate_query("strata_event", sql.by_strata("event"), "event", ("stratum", "relative_period"), strata=True)
_aggregate_query("diff_samples", sql.difference_samples("event"), "event", ("relative_period",), fit={"split_sample_by": "s"}, difference=["s = 0", "s = 1"])
_aggregate_query("agg_weighted", sql.weighted_aggregate(), "event", ("relative_period",), fit={"weights_name": "w", "est_method": "dr", "formula": "y ~ x"})
_aggregate_query("diff_rescaled", sql.difference_rescaled(), "event", ("relative_period",), fit={"split_sample_by": "s"}, difference=["s = 0", "s = 1"], rescale=True)
_aggregate_query("diff_strata", sql.difference_strata("event"), "event", ("relative_period",), strata=True, difference={"strata": [0, 1]})
_aggregate_query("diff_cells", sql.difference_cells(), None, CELL, fit={"split_sample_by": "s"}, difference=True)


@query("diff_both", sql.difference_both("event"))
def diff_both(spark: SparkSession, d: str) -> DataFrame:
    model = ATTgt(suppliers(spark, d).withColumn("h", (F.col("e") % 3 == 0).cast("int")), "g", strata_name="s", entity_name="e", time_name="year")
    model.fit("y", est_method="reg", split_sample_by="h")
    return _effects(model.aggregate("event", difference={"samples": ["h = 0", "h = 1"], "strata": [0, 1]}), "difference_between", "relative_period")


# -- inference

DRAWS, SEED = 99, 5
_aggregate_query("boot_se", sql.bootstrap(DRAWS, SEED), "event", ("relative_period",), boot_iterations=DRAWS, random_state=SEED)


@query("boot_band", sql.bootstrap(DRAWS, SEED, band=True))
def boot_band(spark: SparkSession, d: str) -> DataFrame:
    model = ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year")
    model.fit("y", est_method="reg")
    found = model.aggregate("event", boot_iterations=DRAWS, random_state=SEED)
    return _of(found, found.select("relative_period", *(F.round(c, 4).alias(n) for c, n in (("ATT", "att"), ("std_error", "std_error"), ("lower", "lower"), ("upper", "upper")))))


@query("boot_cluster", sql.bootstrap(DRAWS, SEED, clusters=True))
def boot_cluster(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("e"), F.col("s_nationkey").alias("nation"))
    model = ATTgt(suppliers(spark, d).join(nations, "e"), "g", entity_name="e", time_name="year")
    model.fit("y", est_method="reg", cluster_var="nation")
    return _effects(model.aggregate("event", boot_iterations=DRAWS, random_state=SEED), "relative_period")


@query("diff_cluster", sql.difference_clusters(DRAWS, SEED))
def diff_cluster(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("e"), F.col("s_nationkey").alias("nation"))
    model = ATTgt(suppliers(spark, d).join(nations, "e"), "g", strata_name="s", entity_name="e", time_name="year")
    model.fit("y", est_method="reg", cluster_var="nation")
    return _effects(model.aggregate("event", difference=[0, 1], boot_iterations=DRAWS, random_state=SEED), "relative_period")


@query("attgt_bands", sql.bands())
def attgt_bands(spark: SparkSession, d: str) -> DataFrame:
    found = ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year").fit("y", est_method="reg")
    numbers = [F.round(c, 4).alias(n) for c, n in (("ATT", "att"), ("std_error", "std_error"), ("lower", "lower"), ("upper", "upper"))]
    return _of(found, found.select(*CELL, *numbers, "zero_not_in_cband", "n_sample", "n_total"))


@query("results_filtered", sql.panel(out=f"{sql.OUT} WHERE tt < cg AND cg IN (1997, 1999) AND tt - cg >= -3"))
def results_filtered(spark: SparkSession, d: str) -> DataFrame:
    model = ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year")
    model.fit("y", est_method="reg")
    return _effects(model.results(only={"pre": True, "influence": True, "cohort": [1997, 1999], "relative_period": (-3, None)}), *CELL)


@query("influence_covariance", sql.panel(out="SELECT a.cg AS cohort_a, a.tt AS time_a, b.cg AS cohort_b, b.tt AS time_b, round(sum(a.psi * b.psi) / (SELECT n FROM n), 2) AS value FROM psi a JOIN psi b ON a.e = b.e WHERE a.tt < a.cg AND b.tt < b.cg GROUP BY ALL"))
def influence_covariance(spark: SparkSession, d: str) -> DataFrame:
    from .operators.inference import covariance

    model = ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year")
    model.fit("y", est_method="reg")
    pre = [c for c in model._cells if c["time"] < c["cohort"]]
    names = spark.createDataFrame([(c["cell_id"], c["cohort"], c["time"]) for c in pre], "id int, cohort int, time int")
    found = covariance(model.psi.join(F.broadcast(names), F.col("cell_id") == F.col("id"), "left_semi"), "cell_id", model._totals["full_sample"])
    first, second = (names.select(F.col("id").alias(k), F.col("cohort").alias(f"cohort_{k}"), F.col("time").alias(f"time_{k}")) for k in "ab")
    return found.join(F.broadcast(first), "a").join(F.broadcast(second), "b").select("cohort_a", "time_a", "cohort_b", "time_b", F.round("value", 2).alias("value"))


@query("wald_stat", sql.wald())
def wald_stat(spark: SparkSession, d: str) -> DataFrame:
    model = ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year")
    model.fit("y", est_method="reg")
    w = model.wald_pre_test()
    return spark.createDataFrame([(round(w["wald_stat"], 4), w["df"], round(w["p_value"], 4))], "wald_stat double, df int, p_value double")


# -- panel tools

_SEEN = f"WITH {sql.F2}"


@query("panel_gaps", f"{_SEEN}, l AS (SELECT e, t, lag(t) OVER (PARTITION BY e ORDER BY t) AS b FROM p0) SELECT e, u::INT AS year FROM (SELECT e, unnest(range(b + 1, t)) AS u FROM l WHERE t > b + 1)")
def panel_gaps(spark: SparkSession, d: str) -> DataFrame:
    return tools.missing_times(customers(spark, d), "e", "year").select("e", F.col("year").cast("int"))


@query("reindex_times", f"{_SEEN}, a AS (SELECT e, unnest(range(min(t), max(t) + 1)) AS u FROM p0 GROUP BY e) SELECT a.e, u::INT AS year, round(y, 4) AS y FROM a LEFT JOIN p0 ON p0.e = a.e AND p0.t = u")
def reindex_times(spark: SparkSession, d: str) -> DataFrame:
    return tools.reindex_times(customers(spark, d).select("e", "year", "y"), "e", "year").select("e", F.col("year").cast("int"), F.round("y", 4).alias("y"))


@query("balanced_windows", f"{_SEEN}, s AS (SELECT unnest(range(1995, 2002)) AS a), w AS (SELECT a, (a + 2)::INT AS b FROM s WHERE a + 2 <= (SELECT max(t) FROM p0) AND a >= (SELECT min(t) FROM p0)) SELECT a::INT AS start, b AS \"end\", (SELECT count(*) FROM (SELECT e FROM p0 WHERE t BETWEEN a AND b GROUP BY e HAVING count(DISTINCT t) >= 3)) AS n FROM w")
def balanced_windows(spark: SparkSession, d: str) -> DataFrame:
    return tools.entities_per_window(customers(spark, d), "e", "year", 3)


@query("best_windows", f"{_SEEN}, w AS (SELECT a::INT AS start, (a + k - 1)::INT AS \"end\", k, (SELECT count(*) FROM (SELECT e FROM p0 WHERE t BETWEEN a AND a + k - 1 GROUP BY e HAVING count(DISTINCT t) >= k)) AS n FROM range(1990, 2000) s(a), (SELECT 3 AS k) WHERE a >= (SELECT min(t) FROM p0) AND a + k - 1 <= (SELECT max(t) FROM p0)) SELECT start, \"end\", n FROM w WHERE n = (SELECT max(n) FROM w)")
def best_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of three years that most customers are seen in throughout."""
    return tools.balanced_windows(customers(spark, d), "e", "year", 3, grow=False)


@query("fully_observed", f"{_SEEN} SELECT e, t AS year FROM p0 WHERE e IN (SELECT e FROM p0 GROUP BY e HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM p0 GROUP BY e)))")
def fully_observed(spark: SparkSession, d: str) -> DataFrame:
    return tools.fully_observed(customers(spark, d), "e", "year").select("e", "year")


def _two_events(df: DataFrame) -> DataFrame:
    """Two events for entities of every fourth key, one for others that are treated."""
    first = df.filter("g is not null").select("e", F.col("g").alias("cohort")).distinct()
    again = first.filter("floor(e / 4) % 2 = 0").withColumn("cohort", F.col("cohort") + 2)
    return first.unionByName(again)


_EVENTS = f"WITH {sql.F1}, f AS (SELECT DISTINCT e, g AS cohort FROM p0 WHERE g IS NOT NULL), ev AS (SELECT * FROM f UNION ALL SELECT e, cohort + 2 FROM f WHERE e // 4 % 2 = 0)"
_DUMMIES = ", ".join(f'sum((p0.t - cohort = {k})::INT)::BIGINT AS "p_{k}"' for k in range(-2, 3))


@query("pivot_events", f"{_EVENTS} SELECT e, min(cohort)::INT AS \"1\", (CASE WHEN count(*) > 1 THEN max(cohort) ELSE 0 END)::INT AS \"2\" FROM ev GROUP BY e")
def pivot_events(spark: SparkSession, d: str) -> DataFrame:
    return tools.cohort_table(_two_events(suppliers(spark, d)), "e", "cohort", 2).fillna(0)


@query("pivot_events_panel", f"{_EVENTS}, wide AS (SELECT e, min(cohort)::INT AS \"1\", (CASE WHEN count(*) > 1 THEN max(cohort) ELSE 0 END)::INT AS \"2\" FROM ev GROUP BY e) SELECT e, u::INT AS year, \"1\", \"2\" FROM (SELECT e, unnest(range(min(t), max(t) + 1)) AS u FROM p0 GROUP BY e) JOIN wide USING (e)")
def pivot_events_panel(spark: SparkSession, d: str) -> DataFrame:
    df = suppliers(spark, d)
    return tools.cohort_table(_two_events(df), "e", "cohort", 2, df, "year").fillna(0, ["2"]).select("e", F.col("year").cast("int"), "1", "2")


@query("relative_dummies", f"{_EVENTS} SELECT e, p0.t AS year, {_DUMMIES} FROM p0 JOIN ev USING (e) GROUP BY e, p0.t")
def relative_dummies(spark: SparkSession, d: str) -> DataFrame:
    df = suppliers(spark, d)
    return tools.relative_dummies(df, _two_events(df), "e", "year", -2, 2)


_BINNED = ", ".join(['(sum("p_-2") OVER (PARTITION BY e ORDER BY year DESC))::BIGINT AS "p_-2"', '"p_-1"', '"p_0"', '"p_1"', '(sum("p_2") OVER (PARTITION BY e ORDER BY year))::BIGINT AS "p_2"'])


@query("binned_dummies", f"{_EVENTS}, dm AS (SELECT e, p0.t AS year, {_DUMMIES} FROM p0 JOIN ev USING (e) GROUP BY e, p0.t) SELECT e, year, {_BINNED} FROM dm")
def binned_dummies(spark: SparkSession, d: str) -> DataFrame:
    df = suppliers(spark, d)
    return tools.binned_dummies(tools.relative_dummies(df, _two_events(df), "e", "year", -2, 2), "e", "year")


# -- timestamps, streams, simulation, callers' estimators


@query("attgt_datetime", sql.dated())
def attgt_datetime(spark: SparkSession, d: str) -> DataFrame:
    found = ATTgt(weeks(spark, d), "g", entity_name="e", time_name="week", freq="W-MON").fit("y", est_method="reg", as_repeated_cross_section=False)
    return _effects(found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in CELL}), *CELL)


@query("stream_weekly_means", "SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(value) AS n, round(avg(value), 6) AS y FROM events GROUP BY 1, 2")
def stream_weekly_means(spark: SparkSession, d: str) -> DataFrame:
    """The operator of a stream, on the whole table at once."""
    found = windowed_means(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value")
    return found.select("user_id", F.date_format("time", "yyyy-MM-dd").alias("week"), "n", F.round("y", 6).alias("y"))


@query("simulate_panel", sql.simulated())
def simulate_panel(spark: SparkSession, d: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("effect", "x0", "y", "weights")]
    return simulate_data(spark, nentity=200).select("entity", "time", F.coalesce("cohort", F.lit(0)).alias("cohort"), F.coalesce(F.round("intensity", 6), F.lit(0.0)).alias("intensity"), *rounded)


@query("custom_estimator", sql.panel(out="SELECT cg AS cohort, base AS base_period, tt AS time, round(att, 4) AS att, round(se, 4) AS std_error FROM att JOIN se USING (i, cg, base, tt)"))
def custom_estimator(spark: SparkSession, d: str) -> DataFrame:
    def means(endog, exog, treated, weights, post):
        t, c = treated == 1, treated == 0
        a1, a0 = endog[t].mean(), endog[c].mean()
        return {"att": a1 - a0, "influence_func": len(endog) * (t * (endog - a1) / t.sum() - c * (endog - a0) / c.sum())}

    return _effects(ATTgt(suppliers(spark, d), "g", entity_name="e", time_name="year").fit("y", est_method=means), *CELL)
