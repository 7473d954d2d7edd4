"""Contrasts of effects between two strata, two samples, or two pairs of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import Aggregate
from .local import small_table


@dataclass
class Side:
    sample: str
    stratum: object

    def label(self, samples: bool, strata: bool) -> str:
        parts = [self.sample] * samples + [str(self.stratum)] * strata
        return ", ".join(parts)


@dataclass
class Contrast:
    label: str
    sample: str | None
    stratum: object
    value: object
    att: float
    first: int
    second: int
    #: Units behind the difference: those of the sample, or of both samples together.
    n: int


def sides(samples: list[str], strata: list, difference: object) -> list[tuple[Side, Side, bool, bool]]:
    """(first, second, whether samples differ, whether strata differ) for what the caller asks.

    True: the two samples, or the two strata; where both are two, the caller must say which. A list of two names: samples if they are samples, else strata.
    A dict with "samples" (or "sample_names") and / or "strata": the two of each; with both, (s0, t0) - (s1, t1).
    """
    named: dict[str, list] = {}
    if isinstance(difference, dict):
        for key, want in difference.items():
            name = "strata" if key.startswith("str") else "samples" if key.startswith("sam") else None
            if name is None:
                raise ValueError(f"difference: unknown key {key!r}")
            named[name] = list(want)
    elif isinstance(difference, (list, tuple)):
        named["samples" if all(x in samples for x in difference) else "strata"] = list(difference)
    elif difference is True:
        if len(samples) == 2 and len(strata) == 2:
            raise ValueError('difference=True: two samples and two strata; name them, as in {"samples": [...]} or {"strata": [...]}')
        if len(samples) == 2:
            named["samples"] = samples
        elif len(strata) == 2:
            named["strata"] = strata
        else:
            raise ValueError("difference=True needs two samples or two strata")
    for name, have in (("samples", samples), ("strata", strata)):
        if name in named and (len(named[name]) != 2 or any(x not in have for x in named[name])):
            raise ValueError(f"difference: two of the {name} {have} are needed, not {named[name]}")
    if "samples" in named and "strata" in named:
        (a, b), (s, t) = named["samples"], named["strata"]
        return [(Side(a, s), Side(b, t), True, True)]
    if "samples" in named:
        a, b = named["samples"]
        return [(Side(a, s), Side(b, s), True, False) for s in strata]
    s, t = named["strata"]
    return [(Side(a, s), Side(a, t), False, True) for a in samples]


def contrasts(found: list[Aggregate], pairs: list[tuple[Side, Side, bool, bool]], n_total: dict[str, int]) -> list[Contrast]:
    """For each pair, the rows that both sides have."""
    out = []
    for a, b, by_sample, by_stratum in pairs:
        second = {x.value: k for k, x in enumerate(found) if (x.sample, x.stratum) == (b.sample, b.stratum)}
        for k, x in enumerate(found):
            if (x.sample, x.stratum) == (a.sample, a.stratum) and x.value in second:
                j = second[x.value]
                n = n_total[a.sample] + n_total[b.sample] if by_sample else n_total[a.sample]
                label = f"{a.label(by_sample, by_stratum)} - {b.label(by_sample, by_stratum)}"
                out.append(Contrast(label, None if by_sample else a.sample, None if by_stratum else a.stratum, x.value, x.att - found[j].att, k, j, n))
    return out


def contrast_influence(diffs: list[Contrast], found: list[Aggregate], psi: DataFrame, n_total: dict[str, int], rescale: bool = False) -> DataFrame:
    """diff_id, unit, psi: the first side's less the second's. psi: agg_id, unit, psi.

    Units of one sample subtract; units of two samples are different units. rescale: multiply each sample's part by n / its own
    units, as the standard error of a difference of independent samples asks; without it, the parts stay as they are.
    """
    rows = []
    for k, d in enumerate(diffs):
        for agg, plus in ((d.first, 1.0), (d.second, -1.0)):
            rows.append((k, agg, plus * (d.n / n_total[found[agg].sample] if rescale else 1.0)))
    weights = small_table(psi.sparkSession, rows, "diff_id int, agg_id int, weight double")
    met = psi.join(F.broadcast(weights), "agg_id")
    keys = ["diff_id", "unit"] if all(d.sample is not None for d in diffs) else ["diff_id", "agg_id", "unit"]
    return met.groupBy(*keys).agg(F.sum(F.col("psi") * F.col("weight")).alias("psi")).select("diff_id", F.col("unit"), "psi")
