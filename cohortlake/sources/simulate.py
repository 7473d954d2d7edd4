"""A panel generator: entities by times with staggered effects. Every number depends on its key and the seed alone, so a
row is the same however the work is dealt out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loaders import uniform

FIRST_YEAR = 1900


def normal(*key: Column | str, seed: int = 0) -> Column:
    """A standard normal number of the key (Box and Muller)."""
    u, v = uniform(*key, seed=seed), uniform(*key, seed=seed + 7919)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def effect_path(relative: Column, tau: float = 1.0, alpha: float = 0.0, positive_effect: bool = True, bound_effect: bool = True) -> Column:
    """The share of an event's effect so many periods after it: from the first period after the event on it grows by 1 / tau a
    period, up to 1 if bound; without tau it is 1 at once. With alpha it falls, linearly over another tau periods, by 1 / alpha in all.
    positive_effect False: no effect."""
    after = relative > 0
    if not positive_effect:
        return F.lit(0.0)
    if not tau:
        return after.cast("double")
    ramp = F.least(relative / tau, F.lit(1.0)) if bound_effect else relative / tau
    if alpha:
        ramp = ramp - F.when(relative > tau, F.least((relative - tau) / tau, F.lit(1.0)) / alpha).otherwise(0.0)
    return F.when(after, ramp).otherwise(0.0)


def cohort_bounds(n_cohorts: int, cohort_shares: float | list[float] | None) -> list[float]:
    """Where each cohort ends, as shares of the treated: one share for each cohort, and the last takes what is left."""
    shares = [1 / n_cohorts] * n_cohorts if cohort_shares is None else cohort_shares if isinstance(cohort_shares, list) else [cohort_shares]
    if sum(shares) > 1 + 1e-9:
        raise ValueError("'cohort_shares' must not add up to more than 1")
    return [sum(shares[: k + 1]) for k in range(len(shares) - 1)] + [1.0]


def with_intensity(events: DataFrame, cohorts: list[int], by: str | int | tuple | None, low: float, high: float, random_func: Callable[..., Column] | None, samples: int, seed: int) -> DataFrame:
    """events (id, cohort) with samples, strata (, strata1, ...) and intensity.

    by: "entity" draws one for each entity; "cohort", a number of strata, or a tuple of numbers and "cohort" give one to each group,
    samples included; None gives none. Groups are numbered in the order of their parts and draw from [low, high], or without
    random_func are spaced evenly over it.
    """
    group, groups = F.lit(0), 1

    def part(df: DataFrame, name: str, n: int, key: int) -> DataFrame:
        nonlocal group, groups
        df = df.withColumn(name, F.floor(uniform("id", seed=seed + key) * n).cast("int"))
        group, groups = group * n + F.col(name), groups * n
        return df

    if samples:
        events = part(events, "samples", samples, 5)
    treated = F.col("cohort").isNotNull()
    if by is None:
        return events
    if by == "entity":
        return events.withColumn("intensity", F.when(treated, low + (high - low) * (random_func or uniform)("id", F.lit("intensity"), seed=seed + 4)))
    parts = by if isinstance(by, tuple) else (by,)
    if bad := [x for x in parts if x != "cohort" and not (isinstance(x, int) and x > 0)]:
        raise ValueError(f"'intensity_by': unknown {bad}")
    strata = [x for x in parts if x != "cohort"]
    for k, n in enumerate(strata):
        name = f"strata{k or ''}"
        events = part(events, name, n, 30 + k)
        events = events.withColumn(name, F.when(treated, F.col(name)))
    if "cohort" in parts:
        order = F.lit(0)
        for k, c in enumerate(sorted(cohorts)):
            order = F.when(F.col("cohort") == c, k).otherwise(order)
        group, groups = group * len(cohorts) + order, groups * len(cohorts)
    share = random_func(group, F.lit("intensity"), seed=seed + 4) if random_func else group / float(max(groups - 1, 1))
    return events.withColumn("intensity", F.when(treated, low + (high - low) * share))


def simulate_data(
    spark: SparkSession,
    nentity: int = 1000,
    ntime: int = 8,
    nexog: int = 1,
    const: bool = False,
    missing: float = 0.0,
    other_effects: int = 2,
    ncats: int | list[int] = 1,
    share_treated: float = 0.8,
    n_cohorts: int = 3,
    cohort_shares: float | list[float] | None = None,
    effect_size: float = 10.0,
    tau: float = 10.0,
    alpha: float = 0.0,
    positive_effect: bool = True,
    bound_effect: bool = False,
    unbalance: bool = False,
    intensity_by: str | int | tuple | None = "cohort",
    low: float = 0.5,
    high: float = 10.0,
    random_func: Callable[..., Column] | None = None,
    samples: int = 0,
    datetime: bool = False,
    seed: int = 0,
) -> DataFrame:
    """entity, time, cohort (null: never), y, x0.., effect, other_0.., weights (, intensity, strata.., samples, const).

    An event's effect is effect_size times its intensity times ``effect_path``; y has normal noise of that size besides. Cohorts start at
    evenly spaced times after the first. intensity_by, random_func: see ``with_intensity``. unbalance keeps four rows in five.
    """
    cats = ncats if isinstance(ncats, list) else [ncats] * other_effects
    bounds = [x * share_treated for x in cohort_bounds(n_cohorts, cohort_shares)]
    starts = [FIRST_YEAR + 1 + (k + 1) * (ntime - 1) // (len(bounds) + 1) for k in range(len(bounds))]
    u = uniform("id", seed=seed + 1)
    cohort = F.lit(None).cast("int")
    for start, bound in reversed(list(zip(starts, bounds))):
        cohort = F.when(u < bound, start).otherwise(cohort)
    entities = spark.range(nentity).withColumn("cohort", cohort).withColumn("level", normal("id", seed=seed + 2))
    entities = with_intensity(entities, starts, intensity_by, low, high, random_func, samples, seed)
    rows = entities.withColumn("time", F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(FIRST_YEAR + ntime - 1))))
    size = effect_size * (F.col("intensity") if intensity_by is not None else F.lit(1.0))
    effect = size * effect_path(F.col("time") - F.col("cohort"), tau, alpha, positive_effect, bound_effect)
    rows = rows.withColumn("effect", F.when(F.col("cohort").isNull(), 0.0).otherwise(effect))
    y = F.col("level") + 0.1 * (F.col("time") - FIRST_YEAR) + F.col("effect") + effect_size * normal("id", "time", seed=seed + 6)
    for k in range(nexog):
        x = normal("id", "time", seed=seed + 100 + k)
        rows = rows.withColumn(f"x{k}", F.when(uniform("id", "time", seed=seed + 200 + k) >= missing, x) if missing else x)
        y = y + (k + 1) * F.coalesce(x, F.lit(0.0))
    for k, n in enumerate(cats):
        rows = rows.withColumn(f"other_{k}", F.floor(uniform("id", seed=seed + 300 + k) * max(1, n)).cast("int"))
        y = y + F.col(f"other_{k}")
    if const:
        rows = rows.withColumn("const", F.lit(1.0))
    rows = rows.withColumn("y", y).withColumn("weights", 0.5 + uniform("id", seed=seed + 8))
    if unbalance:
        rows = rows.filter(uniform("id", "time", seed=seed + 9) < 0.8)
    if datetime:
        date = lambda c: F.make_timestamp(F.col(c), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        rows = rows.withColumns({"time": date("time"), "cohort": date("cohort")})
    rows = rows.withColumn("entity", F.concat(F.lit("e"), F.col("id").cast("string"))).drop("id", "level")
    return rows.select("entity", "time", *(c for c in rows.columns if c not in ("entity", "time")))
