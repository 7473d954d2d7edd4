"""Aggregation of group-time effects: simple, event, cohort and time, and their overall means.

Every aggregate is a fixed combination of cells plus, where shares of cohorts are estimated, a term for each unit of an
aggregated cohort: sum over cells of w_i 1{i in c} (ATT_c - ATT) / S. Both parts are few numbers (by cell, by cohort and
stratum), so an aggregate's influence function takes two broadcast joins and one sum by unit.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .local import small_table

TYPES = ("simple", "event", "cohort", "time")
#: What identifies a row of each type; overall rows and simple have nothing.
FIELD = {"simple": None, "event": "relative_period", "cohort": "cohort", "time": "time"}


@dataclass
class Aggregate:
    """One number: sample, stratum, field value, att, the weights of its cells and the loads of its cohorts."""

    sample: str
    stratum: object
    value: int | None
    att: float
    cells: dict[int, float]
    loads: dict[tuple, float]


def _weighted(cells: list[dict], shares: dict[tuple, float], value: int | None, sample: str, stratum: object) -> Aggregate:
    total = sum(shares[c["cohort"], c["stratum"]] for c in cells)
    weights = {c["cell_id"]: shares[c["cohort"], c["stratum"]] / total for c in cells}
    att = sum(weights[c["cell_id"]] * c["att"] for c in cells)
    loads: dict[tuple, float] = defaultdict(float)
    for c in cells:
        loads[c["cohort"], c["stratum"]] += (c["att"] - att) / total
    return Aggregate(sample, stratum, value, att, weights, dict(loads))


def _mean(parts: list[Aggregate], sample: str, stratum: object, value: int | None = None) -> Aggregate:
    cells, loads = defaultdict(float), defaultdict(float)
    for p in parts:
        for k, v in p.cells.items():
            cells[k] += v / len(parts)
        for k, v in p.loads.items():
            loads[k] += v / len(parts)
    return Aggregate(sample, stratum, value, sum(p.att for p in parts) / len(parts), dict(cells), dict(loads))


def aggregates(cells: list[dict], shares: dict[str, dict[tuple, float]], kind: str, overall: bool = False) -> list[Aggregate]:
    """cells: dicts of sample, cell_id, cohort, time, stratum, att (None: failed); shares: sample -> (cohort, stratum) -> mean weight.

    simple, event and time weigh cells by their cohorts' shares; a cohort's effect is the plain mean over its times; the overall
    effects of event (from 0 on) and time are plain means, that of cohort is weighted by shares.
    """
    if kind not in TYPES:
        raise ValueError(f"unknown aggregation {kind!r}: {TYPES}")
    out = []
    groups: dict[tuple, list[dict]] = defaultdict(list)
    for c in cells:
        if c["att"] is not None:
            groups[c["sample"], c["stratum"]].append(c)
    for (sample, stratum), own in sorted(groups.items(), key=lambda g: (g[0][0], str(g[0][1]))):
        post = [c for c in own if c["time"] >= c["cohort"]]
        share = shares[sample]
        if kind == "simple":
            out += [_weighted(post, share, None, sample, stratum)] if post else []
            continue
        by: dict[int, list[dict]] = defaultdict(list)
        for c in own if kind == "event" else post:
            by[c["time"] - c["cohort"] if kind == "event" else c[kind]].append(c)
        if kind == "cohort":
            rows = [_mean([Aggregate(sample, stratum, g, c["att"], {c["cell_id"]: 1.0}, {}) for c in part], sample, stratum, g) for g, part in sorted(by.items())]
        else:
            rows = [_weighted(part, share, v, sample, stratum) for v, part in sorted(by.items())]
        if not overall:
            out += rows
        elif kind == "cohort" and rows:
            total = sum(share[r.value, stratum] for r in rows)
            weight = {r.value: share[r.value, stratum] / total for r in rows}
            att = sum(weight[r.value] * r.att for r in rows)
            combined = {k: weight[r.value] * v for r in rows for k, v in r.cells.items()}
            out.append(Aggregate(sample, stratum, None, att, combined, {(r.value, stratum): (r.att - att) / total for r in rows}))
        elif rows := [r for r in rows if kind == "time" or r.value >= 0]:
            out.append(_mean(rows, sample, stratum))
    return out


def shares_of(units: DataFrame, n_total: dict[str, int]) -> dict[str, dict[tuple, float]]:
    """sample -> (cohort, stratum) -> the cohort's summed weight by the sample's units. units: sample, g, s, w."""
    out: dict[str, dict[tuple, float]] = defaultdict(dict)
    for r in units.filter("g is not null").groupBy("sample", "g", "s").agg(F.sum("w").alias("w")).collect():  # cohorts x strata
        out[r["sample"]][r["g"], r["s"]] = r["w"] / n_total[r["sample"]]
    return out


def influence(found: list[Aggregate], psi: DataFrame, units: DataFrame) -> DataFrame:
    """agg_id, unit, psi of every aggregate. psi: sample, cell_id, unit, psi; units: sample, unit, g, s, w."""
    spark = psi.sparkSession
    s = units.schema["s"].dataType.simpleString()
    cells = small_table(spark, [(k, a.sample, c, float(w)) for k, a in enumerate(found) for c, w in a.cells.items()], "agg_id int, sample string, cell_id int, weight double")
    loads = small_table(spark, [(k, a.sample, g, st, float(v)) for k, a in enumerate(found) for (g, st), v in a.loads.items()], f"agg_id int, sample string, g int, s {s}, load double")
    direct = psi.join(F.broadcast(cells), ["sample", "cell_id"]).select("agg_id", "unit", (F.col("psi") * F.col("weight")).alias("psi"))
    same = (units["sample"] == loads["sample"]) & (units["g"] == loads["g"]) & units["s"].eqNullSafe(loads["s"])
    shared = units.join(F.broadcast(loads), same).select("agg_id", "unit", (F.col("w") * F.col("load")).alias("psi"))
    return direct.unionByName(shared).groupBy("agg_id", "unit").agg(F.sum("psi").alias("psi"))
