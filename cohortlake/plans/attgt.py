"""ATTgt: group-time average treatment effects of a panel or repeated cross-section, planned once over all cells."""

from __future__ import annotations

import warnings
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.formula import INTERCEPT, design, split_formula
from cohortlake.functions.stats import z_quantile
from cohortlake.operators import aggregate as agg
from cohortlake.operators import cells as planning
from cohortlake.operators import contrast
from cohortlake.operators import estimators, inference, xsection
from cohortlake.operators.local import small_table
from cohortlake.operators.panel import G, T, UNIT, no_nan, prepare, time_varying

FULL = "full_sample"
BASES = {"var": "varying", "uni": "universal"}
#: Cells are planned and solved on the driver and broadcast: a row for each, so many at most.
MOST_CELLS = 200_000
CONTROLS = {"nev": "never_treated", "not": "not_yet_treated"}


def _limit(n: int) -> None:
    if n > MOST_CELLS:
        raise ValueError(f"{n} cells or more: choose some with filter_cells, or coarser times, strata or samples")


def _release(*held: list[DataFrame]) -> None:
    for some in held:
        while some:
            df = some.pop()
            if df.sparkSession.getActiveSession() is not None:
                df.unpersist()


class ATTgt:
    """data: a DataFrame whose rows are keyed by entity_name and time_name (its first two columns, if not named)."""

    def __init__(
        self,
        data: DataFrame,
        cohort_name: str,
        strata_name: str | None = None,
        base_period: str = "varying",
        anticipation: int = 0,
        freq: str | None = None,
        entity_name: str | None = None,
        time_name: str | None = None,
        cohort_data: DataFrame | None = None,
    ):
        self.base_period_type = BASES.get(base_period[:3])
        if self.base_period_type is None:
            raise ValueError("'base_period' must be 'varying' or 'universal'")
        if anticipation < 0:
            raise ValueError("'anticipation' must be >= 0")
        self.entity_name, self.time_name = entity_name or data.columns[0], time_name or data.columns[1]
        self.cohort_name, self.strata_name, self.anticipation, self.freq = cohort_name, strata_name, anticipation, freq
        # every step below reads the data again: what made it is computed once
        self._data = data.persist()
        self.panel = prepare(self._data, self.entity_name, self.time_name, cohort_name, anticipation, freq, cohort_data)
        self.is_panel, self.is_balanced_panel = self.panel.is_panel, self.panel.is_balanced
        self._fitted, self._stratum = False, None
        self._kept: list[DataFrame] = []
        self._results: dict[tuple, weakref.ref[DataFrame]] = {}
        weakref.finalize(self, _release, [self._data], self._kept).atexit = False

    # -- planning ---------------------------------------------------------------------------------------------------

    def _planned(self, feasible: bool = False) -> list[tuple]:
        """(cohort, base_period, time, stratum) of every cell, by stratum, cohort and time. Raises above MOST_CELLS, before any collect."""
        found = planning.planned(self.panel.grid, self.anticipation, self.base_period_type)
        if feasible:
            found = planning.possible(found, self.panel.grid)
        strata: list[object] = [None]
        if self.strata_name and found:
            strata = [r[0] for r in self._strata_table().limit(MOST_CELLS // len(found) + 1).collect()]
        _limit(len(found) * len(strata))
        return [(*c, s) for s in sorted(strata, key=str) for c in found]

    def group_time(self, feasible: bool = False) -> DataFrame:
        """The cells: cohort, base_period, time (, stratum)."""
        found = self._planned(feasible)
        if not self.strata_name:
            return small_table(self.panel.df.sparkSession, [c[:3] for c in found], planning.CELLS)
        return small_table(self.panel.df.sparkSession, found, f"{planning.CELLS}, stratum {self._strata_table().schema['stratum'].dataType.simpleString()}")

    def _strata_table(self) -> DataFrame:
        if self._stratum is None:
            self._stratum = planning.stratum(self.panel.df, self.strata_name)
        return self.panel.df.select(self._stratum.alias("stratum")).filter("stratum is not null").distinct()

    def _covariates(self, names: list[str], columns: list[Column], df: DataFrame, base_delta: object) -> tuple[list[str], list[str]]:
        """Which design columns enter as levels and which as changes."""
        bare = [n for n in names if n != INTERCEPT]
        if base_delta == "base" or base_delta == ["base"]:
            return names, []
        varied = df.select(F.col(UNIT).alias("unit"), *(c.alias(f"x{k}") for k, c in enumerate(columns)))
        found = time_varying(varied, "unit", [f"x{k}" for k, n in enumerate(names) if n != INTERCEPT])
        varying = [n for k, n in enumerate(names) if f"x{k}" in found]
        if isinstance(base_delta, dict):
            base, delta = base_delta.get("base"), base_delta.get("delta")
            base = bare if base is None else list(base)
            delta = varying if delta is None else list(delta)
            if missing := [n for n in base + delta if n not in bare]:
                raise ValueError(f"{missing} missing from the design")
            if fixed := [n for n in delta if n not in varying]:
                warnings.warn(f"{fixed} do not vary over time: their changes are left out", stacklevel=3)
            delta = [n for n in delta if n in varying]
            if left := [n for n in bare if n not in base + delta]:
                warnings.warn(f"{left} are in the formula but neither in base nor in delta: left out", stacklevel=3)
        else:
            want = [base_delta] if isinstance(base_delta, str) else list(base_delta)
            if bad := [x for x in want if x not in ("base", "delta")]:
                raise ValueError(f"base_delta: unknown {bad}")
            base, delta = (bare if "base" in want else []), varying
            if left := [n for n in bare if n not in base + delta]:
                warnings.warn(f"{left} do not vary over time: left out", stacklevel=3)
        return [INTERCEPT] * (INTERCEPT in names) + base, delta

    # -- estimation -------------------------------------------------------------------------------------------------

    def fit(
        self,
        formula: str,
        weights_name: str | None = None,
        control_group: str = "never_treated",
        base_delta: str | list | dict = "base",
        est_method: str | Callable = "dr",
        as_repeated_cross_section: bool | None = None,
        boot_iterations: int = 0,
        random_state: int | None = None,
        alpha: float = 0.05,
        cluster_var: list | str | None = None,
        split_sample_by: Callable | str | None = None,
        n_jobs: int = 1,
        backend: str | None = None,
        progress_bar: bool = False,
        filter_cells: dict | None = None,
    ) -> DataFrame:
        """Estimates every cell; n_jobs, backend and progress_bar are accepted and have no meaning here.

        as_repeated_cross_section: None estimates an unbalanced panel as a cross-section clustered by entity; True asks for that,
        False balances every cell's two times instead.
        """
        if control_group[:3] not in CONTROLS:
            raise ValueError("'control_group' must be 'never_treated' or 'not_yet_treated'")
        control = CONTROLS[control_group[:3]]
        if control == "never_treated" and self.panel.no_never_treated:
            raise ValueError("no never treated entities: use control_group='not_yet_treated'")
        method = est_method if callable(est_method) else estimators.method_name(est_method)
        if boot_iterations < 0:
            raise ValueError("'boot_iterations' must be >= 0")
        self._drop_kept()
        y_name, right = split_formula(formula)
        df, strata = self.panel.df, self.strata_name
        plan = design(df, right)
        used = [c for c in dict.fromkeys([*plan.used, *([y_name] if y_name in df.columns else [])])]
        if used:
            df = df.select(*(no_nan(df, c).alias(c) if c in used else F.col(c) for c in df.columns)).dropna(subset=used)  # unbalanced rows then meet no partner
        cross = not self.is_panel or (not self.is_balanced_panel if as_repeated_cross_section is None else bool(as_repeated_cross_section))
        clusters = [cluster_var] if isinstance(cluster_var, str) else list(cluster_var or [])
        clusters = [c for c in clusters if c != self.entity_name]
        if len(clusters) > 1:
            raise ValueError("at most one cluster variable besides the entity")
        if clusters and self.is_panel and time_varying(df, UNIT, clusters):
            raise ValueError("the cluster variable must not vary over time")
        base, delta = ((plan.names, []) if cross else self._covariates(plan.names, plan.columns, df, base_delta))
        column = dict(zip(plan.names, plan.columns))
        sample = F.lit(FULL)
        if isinstance(split_sample_by, str):
            sample = F.concat(F.lit(f"{split_sample_by} = "), no_nan(df, split_sample_by).cast("string"))
        elif split_sample_by is not None:
            sample = F.when(split_sample_by(df), "split = True").otherwise("split = False")
        weight = F.col(weights_name).cast("double") if weights_name else F.lit(1.0)
        found_cells = self._planned()
        s = self._stratum if strata and self._stratum is not None else F.lit(None).cast("string")
        values = df.select(
            sample.alias("sample"), F.col(UNIT).alias("unit"), F.col(T).alias("t"), F.col(G).alias("g"), s.alias("s"), F.expr(y_name).cast("double").alias("y"), weight.alias("w"),
            F.array(*(column[n] for n in base) if base else [F.lit(None).cast("double")]).alias("x"), F.array(*(column[n] for n in delta)).cast("array<double>").alias("dx"),
            *([F.col(clusters[0]).alias("cluster")] if clusters else []),
        ).filter("sample is not null")
        if not base and not delta:
            raise ValueError("the formula has no column")
        if not base:
            values = values.withColumn("x", F.array().cast("array<double>"))
        by_unit = self.is_panel or not cross
        values = values.persist()
        self._kept.append(values)
        if filter_cells:
            names = ["cohort", "base_period", "time", *(["stratum"] if strata else [])]
            some = {tuple(r[n] for n in names) for r in planning.chosen(self.group_time(), **filter_cells).collect()}  # the planned cells at most
            found_cells = [c for c in found_cells if c[: len(names)] in some]
        stratum_type = values.schema["s"].dataType.simpleString()
        spark = df.sparkSession
        small = small_table(spark, [(k, *c) for k, c in enumerate(found_cells)], f"cell_id int, cohort int, base_period int, time int, stratum {stratum_type}")
        work = small.filter("base_period <> time")
        units = values.groupBy("sample", "unit").agg(F.max("g").alias("g"), F.max("s").alias("s"), F.min_by("w", "t").alias("w"), *([F.first("cluster").alias("cluster")] if clusters else [])) if by_unit else values.select("sample", "unit", "g", "s", "w", *(["cluster"] if clusters else []))
        totals = {r["sample"]: r["n"] for r in units.groupBy("sample").agg(F.count("*").alias("n")).limit(MOST_CELLS // max(1, len(found_cells)) + 1).collect()}
        _limit(len(totals) * len(found_cells))
        if cross:
            rows = xsection.cross_section_rows(values, work, control, bool(strata), self.anticipation)
        else:
            gathered = xsection.unit_rows(values, ["y", "w", "x", "dx"], True)
            rows = xsection.panel_rows(gathered, work, control, bool(strata), self.anticipation, bool(delta))
        k = len(base) + len(delta)
        if method != "reg" or k > 1 or callable(method):
            rows = rows.persist()
            self._kept.append(rows)
        att: dict[tuple, tuple[float, int]] = {}
        errors: dict[tuple, str] = {}
        psi = None
        if callable(method):
            custom = estimators.estimate_custom(rows, k, method, cross).persist()
            self._kept.append(custom)
            for r in custom.groupBy("sample", "cell_id").agg(F.first("att").alias("att"), F.first("n_sample").alias("n"), F.first("error").alias("error")).collect():
                key = r["sample"], r["cell_id"]
                if r["error"] is None:
                    att[key] = r["att"], r["n"]
                else:
                    errors[key] = r["error"]
            psi = custom.filter("error is null").select("sample", "cell_id", "unit", "psi")
        elif found_cells:
            got = estimators.estimate(rows, k, method, cross)
            att, psi, errors = got.att, got.psi, got.errors
        if psi is None:
            psi = spark.createDataFrame([], f"sample string, cell_id int, unit {values.schema['unit'].dataType.simpleString()}, psi double")
        elif att:
            scale = small_table(spark, [(*key, totals[key[0]] / n) for key, (_, n) in att.items()], "sample string, cell_id int, scale double")
            psi = psi.join(F.broadcast(scale), ["sample", "cell_id"]).withColumn("psi", F.col("psi") * F.col("scale")).drop("scale")
        if cross and self.is_panel:
            psi = psi.groupBy("sample", "cell_id", "unit").agg(F.sum("psi").alias("psi"))
        self._cells: list[dict] = []
        for name in sorted(totals):
            for cell_id, c in enumerate(found_cells):
                reference = c[1] == c[2]
                value, n = (0.0, None) if reference else att.get((name, cell_id), (None, None))
                error = None if value is not None else errors.get((name, cell_id), "no rows")
                self._cells.append({"sample": name, "cell_id": cell_id, "cohort": c[0], "base_period": c[1], "time": c[2], "stratum": c[3], "att": value, "n_sample": n, "n_total": totals[name], "error": error})
        self._psi, self._units, self._totals = psi, units, totals
        self._cluster = clusters[0] if clusters else None
        self._cross, self._cluster_by_entity = cross, by_unit
        self._fitted, self._results = True, {}
        self.est_method, self._control_group, self._formula, self._base_delta = method, control, f"{y_name} ~ {right}", {"base": base, "delta": delta}
        self._alpha, self._boot, self._seed = alpha, boot_iterations, random_state
        self.psi, self.units = psi, units
        out = self.results()
        return out

    def _drop_kept(self) -> None:
        _release(self._kept)

    def _owned(self, out: DataFrame) -> DataFrame:
        """A result keeps its model, and the model what it persisted: once both are gone, that is given back."""
        out._model = self
        return out

    def close(self) -> None:
        """Gives back what the model holds in memory."""
        self._drop_kept()
        self._data.unpersist()

    # -- output -----------------------------------------------------------------------------------------------------

    def _need_fit(self) -> None:
        if not self._fitted:
            raise RuntimeError("call fit() first")

    @property
    def sample_names(self) -> list[str]:
        self._need_fit()
        return sorted(self._totals)

    def _strata(self) -> list:
        return sorted({c["stratum"] for c in self._cells}, key=str)

    def _dated(self, df: DataFrame) -> DataFrame:
        """Numbers of times back to dates."""
        if self.panel.dates is None:
            return df
        return df.withColumns({c: self.panel.dates.date(F.col(c)) for c in ("cohort", "base_period", "time") if c in df.columns})

    def _inferred(self, table: DataFrame, psi: DataFrame, key: str, n: dict[int, int], alpha: float, boot: int, seed: int | None, clusters: DataFrame | None) -> DataFrame:
        """table (key, ATT, n_total) with std_error and band; boot: bootstrap draws, 0 for the analytic ones."""
        if not boot:
            errors = psi.groupBy(key).agg(F.sqrt(F.sum(F.col("psi") ** 2)).alias("root"))
            out = table.join(errors, key, "left").withColumn("std_error", F.col("root") / F.col("n_total")).drop("root")
            return inference.with_band(out, z_quantile(1 - alpha / 2)).withColumns({"se_kind": F.lit("analytic"), "ci_kind": F.lit("pointwise conf. band")})
        groups: dict[int, list[int]] = {}
        for k, total in n.items():
            groups.setdefault(total, []).append(k)
        parts = []
        for total, keys in groups.items():
            own, units = psi.filter(F.col(key).isin(keys)), total
            if clusters is not None:
                own, units = inference.clustered(own, [key], clusters)
            drawn = inference.bootstrap(own, key, boot, 0 if seed is None else seed, units).persist()
            self._kept.append(drawn)
            errors, crit = inference.bootstrap_errors(drawn, key, units, alpha)
            value = crit.first()["crit_val"]
            part = table.filter(F.col(key).isin(keys)).join(errors, key, "left")
            parts.append(inference.with_band(part, value if value is not None else float("nan")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumns({"se_kind": F.lit("bootstrap"), "ci_kind": F.lit("simult. conf. band")})

    def _clusters(self, sample: str | None = None) -> DataFrame | None:
        return self._units.select("unit", "cluster") if self._cluster else None

    def results(self, type_of_aggregation: str | None = None, overall: bool = False, difference: object = False, to_dataframe: bool = True, add_info: bool = False, only: dict | None = None) -> DataFrame:
        """The effects of the cells (or, with a type, an aggregate): a DataFrame, or with to_dataframe=False its rows. only: see ``cells.chosen_results``."""
        self._need_fit()
        if type_of_aggregation is not None:
            out = self.aggregate(type_of_aggregation, overall, difference)
            out = planning.chosen_results(out, **only) if only is not None else out
            return out if to_dataframe else out.collect()
        spark = self.panel.df.sparkSession
        kind = self._units.schema["s"].dataType.simpleString()
        rows = [(k, c["sample"], c["stratum"], c["cohort"], c["base_period"], c["time"], c["att"], c["n_sample"], c["n_total"], c["error"]) for k, c in enumerate(self._cells)]
        table = small_table(spark, rows, f"row_id int, sample_name string, stratum {kind}, cohort int, base_period int, time int, ATT double, n_sample long, n_total long, exception string")
        ids = small_table(spark, [(c["sample"], c["cell_id"], k) for k, c in enumerate(self._cells)], "sample string, cell_id int, row_id int")
        psi = self._psi.join(F.broadcast(ids), ["sample", "cell_id"]).select("row_id", "unit", "psi")
        n = {k: c["n_total"] for k, c in enumerate(self._cells) if c["att"] is not None}
        out = self._inferred(table, psi, "row_id", n, self._alpha, self._boot, self._seed, self._clusters()).drop("row_id")
        if not self.strata_name:
            out = out.drop("stratum")
        out = planning.chosen_results(out, **only) if only is not None else out
        if add_info:
            out = out.withColumn("post", F.when(F.col("cohort") < F.col("time"), "post").otherwise("pre"))
        out = self._owned(self._dated(out))
        return out if to_dataframe else out.collect()

    def aggregate(
        self,
        type_of_aggregation: str | None = "simple",
        overall: bool = False,
        difference: bool | list | dict = False,
        alpha: float = 0.05,
        cluster_var: list | str | None = None,
        boot_iterations: int = 0,
        random_state: int | None = None,
        n_jobs: int = 1,
        backend: str | None = None,
        rescale: bool = False,
    ) -> DataFrame:
        """Aggregated effects, or with difference those of one side less the other's.

        With difference, type_of_aggregation None compares the cells themselves. rescale: see contrast_influence.
        """
        self._need_fit()
        if type_of_aggregation is None and not difference:
            return self.results()
        key = (type_of_aggregation, overall, repr(difference), alpha, repr(cluster_var), boot_iterations, random_state, rescale)
        if (known := self._results.get(key, lambda: None)()) is not None:
            return known
        if type_of_aggregation is not None and type_of_aggregation not in agg.TYPES and not difference:
            return self.results()
        if type_of_aggregation is None:
            found = [agg.Aggregate(c["sample"], c["stratum"], (c["cohort"], c["base_period"], c["time"]), c["att"], {c["cell_id"]: 1.0}, {}) for c in self._cells if c["att"] is not None]
        else:
            found = agg.aggregates(self._cells, agg.shares_of(self._units, self._totals), type_of_aggregation, overall)
        psi = agg.influence(found, self._psi, self._units)
        spark, kind = psi.sparkSession, self._units.schema["s"].dataType.simpleString()
        clusters = self._clusters()
        if cluster_var is not None and clusters is None:
            name = cluster_var if isinstance(cluster_var, str) else next((c for c in cluster_var if c != self.entity_name), None)
            clusters = self.panel.df.groupBy(F.col(UNIT).alias("unit")).agg(F.first(name).alias("cluster")) if name else None
        field = agg.FIELD.get(type_of_aggregation) if not overall else None
        if not difference:
            table = small_table(spark, [(k, a.sample, a.stratum, a.value, a.att, self._totals[a.sample]) for k, a in enumerate(found)], f"agg_id int, sample_name string, stratum {kind}, value int, ATT double, n_total long")
            n = {k: self._totals[a.sample] for k, a in enumerate(found)}
            out = self._inferred(table, psi, "agg_id", n, alpha, boot_iterations, random_state, clusters).drop("agg_id", "n_total")
        else:
            diffs = contrast.contrasts(found, contrast.sides(self.sample_names, self._strata(), difference), self._totals)
            apart = contrast.contrast_influence(diffs, found, psi, self._totals, rescale)
            cells = type_of_aggregation is None
            rows = [(k, d.label, d.sample, d.stratum, *(d.value if cells else (d.value,)), d.att, d.n) for k, d in enumerate(diffs)]
            values = "cohort int, base_period int, time int" if cells else "value int"
            table = small_table(spark, rows, f"diff_id int, difference_between string, sample_name string, stratum {kind}, {values}, ATT double, n_total long")
            out = self._inferred(table, apart, "diff_id", {k: d.n for k, d in enumerate(diffs)}, alpha, boot_iterations, random_state, clusters).drop("diff_id", "n_total")
        if "value" in out.columns:
            out = out.withColumnRenamed("value", field) if field else out.drop("value")
        if not self.strata_name or (difference and "stratum" in out.columns and len(self._strata()) < 2):
            out = out.drop("stratum")
        out = self._owned(self._dated(out))
        self._results[key] = weakref.ref(out)
        return out

    def wald_pre_test(self, sample: str | None = None, stratum: object = None) -> dict[str, float]:
        """Whether all effects before treatment are zero."""
        self._need_fit()
        name = sample or self.sample_names[0]
        att = {c["cell_id"]: c["att"] for c in self._cells if c["sample"] == name and c["stratum"] == stratum and c["att"] is not None and c["time"] < c["cohort"] and c["time"] != c["base_period"]}
        return inference.wald_pre_test(att, self._psi.filter(F.col("sample") == name), "cell_id", self._totals[name])

    def estimation_details(self, type_of_aggregation: str | None = None) -> dict[str, object]:
        out: dict[str, object] = {"anticipation": self.anticipation, "base_period_type": self.base_period_type, "is_panel": self.is_panel}
        if self.is_panel:
            out["is_balanced_panel"] = self.is_balanced_panel
        if self._fitted:
            out |= {"estimation_method": self.est_method, "as_repeated_cross_section": self._cross, "control_group": self._control_group, "formula": self._formula, "cluster_by_entity": self._cluster_by_entity}
            if not self._cross:
                out["base_delta"] = self._base_delta
        return out
