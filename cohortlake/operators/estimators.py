"""ATT and influence function of every cell at once.

All estimators of a cell are functions of weighted moments of (1, y, x) and of at most two kinds of coefficients, so one
aggregate over all cells yields what a few small solves on the driver turn into each cell's parameters. Influence functions
are then one expression over the rows, with those parameters broadcast (a row for each cell).

The propensity score is fitted for all cells together: one aggregate for each Newton step. Methods: reg, dr, dr-ipt,
std_ipw, ipw, with the usual linear representations of what they estimate first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .local import small_table

METHODS = ("dr-mle", "dr-ipt", "reg", "std_ipw-mle", "ipw-mle")
ALIASES = {"dr": "dr-mle", "ipw": "ipw-mle", "std_ipw": "std_ipw-mle"}
KEY = ["sample", "cell_id"]
TOLERANCE, STEPS = 1e-11, 40
#: Above so many covariates, moments are summed as whole matrices instead of as single columns.
WIDE = 12


def method_name(method: str) -> str:
    name = ALIASES.get(method, method)
    if name not in METHODS:
        raise ValueError(f"unknown est_method {method!r}: {METHODS} or {tuple(ALIASES)}")
    return name


def dot(x: Column, v: Column, k: int) -> Column:
    out = x[0] * v[0]
    for j in range(1, k):
        out = out + x[j] * v[j]
    return out


@dataclass
class Moments:
    """Means over a cell's rows of weight, weight y, weight x, weight x y and weight x x'."""

    s: float
    y: float
    x: np.ndarray
    xy: np.ndarray
    xx: np.ndarray

    def fit(self, other: Moments | None = None) -> np.ndarray:
        """Least-squares coefficients (by pseudo-inverse: a deficient design does not fail here)."""
        return np.linalg.pinv(self.xx, rcond=1e-12) @ self.xy

    def mean(self, beta: np.ndarray | float = 0.0) -> float:
        """The weighted mean of y - x beta."""
        return float((self.y - np.sum(self.x * beta)) / self.s)


def _moments(rows: DataFrame, weights: dict[str, Column], k: int) -> dict[tuple, tuple[int, dict[str, Moments]]]:
    """n and the moments under each weight, of every cell."""
    names = list(weights)
    size = 2 + 2 * k + k * k
    x, y = F.col("x"), F.col("y")
    if k <= WIDE:
        sums = [F.count("*").alias("n")]
        for i, w in enumerate(weights.values()):
            wx = [w * x[j] for j in range(k)]
            parts = [w, w * y, *wx, *(a * y for a in wx), *(wx[j] * x[l] for j in range(k) for l in range(j, k))]
            sums += [F.sum(p).alias(f"m{i}_{j}") for j, p in enumerate(parts)]
        found = rows.groupBy(*KEY).agg(*sums).collect()  # a row for each cell
        out = {}
        upper = np.triu_indices(k)
        for r in found:
            each = {}
            for i, name in enumerate(names):
                v = np.array([r[f"m{i}_{j}"] for j in range(2 + 2 * k + len(upper[0]))], dtype=float) / r["n"]
                xx = np.zeros((k, k))
                xx[upper] = v[2 + 2 * k :]
                each[name] = Moments(v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + 2 * k], xx + xx.T - np.diag(np.diag(xx)))
            out[r["sample"], r["cell_id"]] = r["n"], each
        return out
    flat = rows.select(*KEY, "y", "x", *(w.alias(f"w{i}") for i, w in enumerate(weights.values())))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for f in frames:
            for key, part in f.groupby(KEY):
                m, yy = np.stack(part["x"].to_list()), part["y"].to_numpy()
                one = [np.array([len(part)], dtype=float)]
                for i in range(len(names)):
                    w = part[f"w{i}"].to_numpy()
                    wm = m * w[:, None]
                    one += [np.array([w.sum(), w @ yy]), wm.sum(axis=0), wm.T @ yy, (wm.T @ m).ravel()]
                total[key] = total.get(key, 0) + np.concatenate(one)
        rows_ = [(*key, j, float(v)) for key, vec in total.items() for j, v in enumerate(vec)]
        yield pd.DataFrame(rows_, columns=[*KEY, "place", "value"])

    kinds = dict(rows.dtypes)
    summed = flat.mapInPandas(partial, f"sample {kinds['sample']}, cell_id {kinds['cell_id']}, place int, value double")
    vectors: dict[tuple, np.ndarray] = {}
    for r in summed.groupBy(*KEY, "place").agg(F.sum("value").alias("value")).collect():
        vectors.setdefault((r["sample"], r["cell_id"]), np.zeros(1 + size * len(names)))[r["place"]] = r["value"]
    out = {}
    for key, vec in vectors.items():
        each = {}
        for i, name in enumerate(names):
            v = vec[1 + i * size : 1 + (i + 1) * size] / vec[0]
            each[name] = Moments(v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + 2 * k], v[2 + 2 * k :].reshape(k, k))
        out[key] = int(vec[0]), each
    return out


def parameters(rows: DataFrame, values: dict[tuple, dict[str, object]], names: list[str]) -> DataFrame:
    """A small DataFrame of a row for each cell; numbers are doubles and vectors arrays."""
    spark = rows.sparkSession
    first = next(iter(values.values()))
    kinds = [T.StructField(n, T.ArrayType(T.DoubleType()) if np.ndim(first[n]) else T.DoubleType()) for n in names]
    schema = T.StructType([T.StructField("sample", rows.schema["sample"].dataType), T.StructField("cell_id", rows.schema["cell_id"].dataType), *kinds])
    data = [(*key, *([float(a) for a in v[n]] if np.ndim(v[n]) else float(v[n]) for n in names)) for key, v in values.items()]
    return small_table(spark, data, schema)


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(params), KEY)  # a row for each cell


#: Distinct rows (cell, d, x) up to which the score is fitted on the driver: some 10 MB.
FEW = 100_000


def _stepped(gamma: np.ndarray, score: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray | None, bool]:
    """The next coefficients of a Newton step (None: none), and whether it was the last."""
    step = np.linalg.pinv(curve, rcond=1e-12) @ score
    if not np.isfinite(step).all() or np.abs(gamma + step).max() > 1e3:
        return None, True
    gamma = gamma + step / max(1.0, np.abs(step).max() / 5)
    return gamma, bool(np.abs(step).max() <= TOLERANCE * (1 + np.abs(gamma).max()))


def _collapsed(rows: DataFrame) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """(d, w, x) of the distinct (d, x) of every cell, w summed, if there are few in all: with discrete covariates there are."""
    about = rows.groupBy(*KEY).agg(F.approx_count_distinct(F.xxhash64("d", "x")).alias("n")).agg(F.sum("n")).first()[0] or 0
    if about > FEW:
        return None
    found = rows.groupBy(*KEY, "d", "x").agg(F.sum("w").alias("w")).limit(2 * FEW + 1).collect()
    if len(found) > 2 * FEW:
        return None
    by: dict[tuple, list] = {}
    for r in found:
        by.setdefault((r["sample"], r["cell_id"]), []).append((r["d"], r["w"], r["x"]))
    return {key: tuple(np.array(v, dtype=float) for v in zip(*part)) for key, part in by.items()}


def _fit_cell(d: np.ndarray, w: np.ndarray, x: np.ndarray, tilt: bool) -> np.ndarray | str:
    """The coefficients of one cell's distinct rows, or why there are none."""
    share = (w @ d) / w.sum() if w.sum() else 0.0
    if not 0 < share < 1:
        return "no treated or no control rows"
    gamma = np.linalg.pinv((x * w[:, None]).T @ x) @ (w @ x) * np.log(share / (1 - share))
    for kind in ("logit", "tilt")[: 1 + tilt]:
        for _ in range(STEPS):
            index = x @ gamma
            p, odds = 1 / (1 + np.exp(-index)), np.exp(index)
            score, curve = (w * (d - p), w * p * (1 - p)) if kind == "logit" else (w * (d - (1 - d) * odds), w * (1 - d) * odds)
            gamma, last = _stepped(gamma, score @ x, (x * curve[:, None]).T @ x)
            if last:
                break
        if gamma is None or not last:
            return f"{kind}: no convergence"
    return gamma


def propensity(rows: DataFrame, k: int, tilt: bool, errors: dict[tuple, str]) -> dict[tuple, np.ndarray]:
    """Coefficients of every cell: the logit's maximum likelihood, or the tilting that balances x exactly.

    Few distinct rows are fitted on the driver; else each Newton step is one aggregate over the rows of all cells.
    """
    rows = rows.select(*KEY, "d", "w", "x")
    few = _collapsed(rows)
    if few is not None:
        fitted = {key: _fit_cell(*part, tilt) for key, part in few.items()}
        errors.update({key: v for key, v in fitted.items() if isinstance(v, str)})
        return {key: v for key, v in fitted.items() if not isinstance(v, str)}
    rows = rows.withColumn("y", F.lit(0.0))
    gamma: dict[tuple, np.ndarray] = {}
    for key, (_, m) in _moments(rows, {"t": F.col("w") * F.col("d"), "c": F.col("w") * (1 - F.col("d"))}, k).items():
        share = m["t"].s / (m["t"].s + m["c"].s) if m["t"].s + m["c"].s else 0.0
        if not 0 < share < 1:
            errors[key] = "no treated or no control rows"
            continue
        total = Moments(*(getattr(m["t"], f) + getattr(m["c"], f) for f in ("s", "y", "x", "xy", "xx")))
        gamma[key] = np.linalg.pinv(total.xx) @ total.x * np.log(share / (1 - share))  # a constant logit, if x holds a constant
    for kind in ("logit", "tilt")[: 1 + tilt]:
        todo = dict(gamma)
        for _ in range(STEPS):
            if not todo:
                break
            met = _with(rows, parameters(rows, {key: {"gamma": v} for key, v in todo.items()}, ["gamma"]))
            index = dot(F.col("x"), F.col("gamma"), k)
            if kind == "logit":
                p = 1 / (1 + F.exp(-index))
                score, curve = F.col("w") * (F.col("d") - p), F.col("w") * p * (1 - p)
            else:
                odds = F.exp(index)
                score, curve = F.col("w") * (F.col("d") - (1 - F.col("d")) * odds), F.col("w") * (1 - F.col("d")) * odds
            again = {}
            for key, (_, m) in _moments(met.select(*rows.columns, score.alias("score"), curve.alias("curve")), {"score": F.col("score"), "curve": F.col("curve")}, k).items():
                gamma[key], last = _stepped(gamma[key], m["score"].x, m["curve"].xx)
                if gamma[key] is None:
                    errors[key] = f"{kind}: no convergence"
                    gamma.pop(key)
                elif not last:
                    again[key] = gamma[key]
            todo = again
        for key in todo:
            errors[key] = f"{kind}: no convergence"
            gamma.pop(key, None)
    return gamma


def _inverse(m: np.ndarray) -> np.ndarray:
    if np.linalg.matrix_rank(m, tol=1e-13 * max(1.0, np.abs(m).max())) < len(m):
        raise ValueError("singular matrix")
    return np.linalg.inv(m)


def _panel_cell(method: str, m: dict[str, Moments], k: int) -> tuple[float, dict]:
    """ATT and the parameters of psi = w1 (y - x b - a1) i1 - w0 (y - x b - a0) i0 + wc (y - x b) x v + w (d - p) x u."""
    zero = np.zeros(k)
    t, c = m["w1"], m["wc"]
    out = {"b": zero, "a1": 0.0, "i1": 1 / t.s, "a0": 0.0, "i0": 0.0, "v": zero, "u": zero}
    if method == "reg":
        b = c.fit()
        att = t.mean(b)
        return att, out | {"b": b, "a1": att, "v": -_inverse(c.xx) @ t.x / t.s}
    o = m["w0"]
    if method == "dr-ipt":
        b = o.fit()
        att = float((t.y - t.x @ b - o.y + o.x @ b) / t.s)
        return att, out | {"b": b, "a1": att, "i0": 1 / t.s}
    if method == "ipw-mle":
        att = (t.y - o.y) / t.s
        return att, out | {"a1": att, "i0": 1 / t.s, "u": -_inverse(m["pp"].xx) @ o.xy / t.s}
    b = c.fit() if method == "dr-mle" else zero
    a1, a0 = t.mean(b), o.mean(b)
    u = -_inverse(m["pp"].xx) @ (o.xy - o.xx @ b - a0 * o.x) / o.s
    v = _inverse(c.xx) @ (o.x / o.s - t.x / t.s) if method == "dr-mle" else zero
    return a1 - a0, out | {"b": b, "a1": a1, "a0": a0, "i0": 1 / o.s, "v": v, "u": u}


def _cross_cell(method: str, m: dict[str, Moments], k: int) -> tuple[float, dict]:
    """The same for repeated cross-sections; suffix 1 is the later time, 0 the base (sign -1).

    psi = sum over s of sign [w1s (y - x bs - a1s) i1s - w0s (y - x bs - a0s) i0s] + wcs (y - x cs) x vs + w1s (y - x hs) x rs
    + w1s (x es + fs) + w (1 - d) ls, and once w d (x q + z) + w (d - p) x u + const.
    """
    zero = np.zeros(k)
    t = {s: m[f"t{s}"] for s in "01"}
    c = {s: m[f"c{s}"] for s in "01"}
    o = {s: m.get(f"o{s}") for s in "01"}
    sign = {"1": 1.0, "0": -1.0}
    out: dict[str, object] = {"q": zero, "z": 0.0, "u": zero, "const": 0.0}
    for s in "01":
        out |= {f"{n}{s}": zero for n in ("b", "c", "v", "h", "r", "e")} | {f"{n}{s}": 0.0 for n in ("a1_", "i1_", "a0_", "i0_", "f", "l")}
    d_s, d_x = t["0"].s + t["1"].s, t["0"].x + t["1"].x
    if method == "reg":
        fit = {s: c[s].fit() for s in "01"}
        cont = float(d_x @ (fit["1"] - fit["0"]) / d_s)
        att = t["1"].mean() - t["0"].mean() - cont
        for s in "01":
            out |= {f"a1_{s}": t[s].mean(), f"i1_{s}": 1 / t[s].s, f"c{s}": fit[s], f"v{s}": -sign[s] * _inverse(c[s].xx) @ d_x / d_s}
        return att, out | {"q": -(fit["1"] - fit["0"]) / d_s, "z": cont / d_s}
    if method == "ipw-mle":
        lam = {s: t[s].s + c[s].s for s in "01"}
        at = {s: t[s].y / (d_s * lam[s]) for s in "01"}
        ac = {s: o[s].y / (d_s * lam[s]) for s in "01"}
        att = (at["1"] - at["0"]) - (ac["1"] - ac["0"])
        for s in "01":
            loss = -sign[s] * (at[s] - ac[s]) / lam[s]
            out |= {f"i1_{s}": 1 / (d_s * lam[s]), f"i0_{s}": 1 / (d_s * lam[s]), f"f{s}": loss, f"l{s}": loss}
        moment = -o["1"].xy / (d_s * lam["1"]) + o["0"].xy / (d_s * lam["0"])
        return att, out | {"z": -att / d_s, "const": att, "u": _inverse(m["pp"].xx) @ moment}
    if method == "std_ipw-mle":
        att, moment = 0.0, zero
        for s in "01":
            a1, a0 = t[s].mean(), o[s].mean()
            att += sign[s] * (a1 - a0)
            out |= {f"a1_{s}": a1, f"i1_{s}": 1 / t[s].s, f"a0_{s}": a0, f"i0_{s}": 1 / o[s].s}
            moment = moment + sign[s] * (o[s].xy - a0 * o[s].x) / o[s].s
        return att, out | {"u": -_inverse(m["pp"].xx) @ moment}
    tilt = method == "dr-ipt"
    att, moment = 0.0, zero
    gap = {}
    for s in "01":
        b = (o[s] if tilt else c[s]).fit()
        h = t[s].fit()
        gap[s] = h - b
        a1, a0 = t[s].mean(b), o[s].mean(b)
        all_, own = float(d_x @ gap[s] / d_s), float(t[s].x @ gap[s] / t[s].s)
        att += sign[s] * (a1 - a0 + all_ - own)
        out |= {f"b{s}": b, f"a1_{s}": a1, f"i1_{s}": 1 / t[s].s, f"a0_{s}": a0, f"i0_{s}": 1 / o[s].s}
        out |= {f"e{s}": -sign[s] * gap[s] / t[s].s, f"f{s}": sign[s] * own / t[s].s}
        out["q"] = out["q"] + sign[s] * gap[s] / d_s
        out["z"] = out["z"] - sign[s] * all_ / d_s
        if not tilt:
            moment = moment + sign[s] * (o[s].xy - o[s].xx @ b - a0 * o[s].x) / o[s].s
            # the outcome coefficients enter the treated and the control means with one sign at either time
            spread = d_x / d_s - t[s].x / t[s].s
            out |= {f"c{s}": b, f"h{s}": h, f"v{s}": _inverse(c[s].xx) @ (o[s].x / o[s].s - t[s].x / t[s].s - sign[s] * spread), f"r{s}": sign[s] * _inverse(t[s].xx) @ spread}
    if not tilt:
        out["u"] = -_inverse(m["pp"].xx) @ moment
    return att, out


@dataclass
class Estimates:
    """att: a row for each cell (sample, cell_id, att, n_sample, error); psi: sample, cell_id, unit, psi, unscaled."""

    att: dict[tuple, tuple[float, int]]
    psi: DataFrame | None
    errors: dict[tuple, str] = field(default_factory=dict)


def estimate(rows: DataFrame, k: int, method: str, cross: bool) -> Estimates:
    """All cells of rows (see xsection) by one method."""
    errors: dict[tuple, str] = {}
    w, d, y, x = F.col("w"), F.col("d"), F.col("y"), F.col("x")
    scored = method != "reg"
    if scored:
        gamma = propensity(rows, k, method == "dr-ipt", errors)
        if not gamma:
            return Estimates({}, None, errors)
        rows = _with(rows, parameters(rows, {key: {"gamma": v} for key, v in gamma.items()}, ["gamma"]))
        index = dot(x, F.col("gamma"), k)
        rows = rows.withColumn("p", 1 / (1 + F.exp(-index))).withColumn("odds", F.exp(index)).drop("gamma")
    p, odds = F.col("p"), F.col("odds")
    if cross:
        post = F.col("post")
        side = {"1": post, "0": 1 - post}
        weights = {f"t{s}": w * d * on for s, on in side.items()} | {f"c{s}": w * (1 - d) * on for s, on in side.items()}
        weights |= {f"o{s}": w * (1 - d) * odds * on for s, on in side.items()} if scored else {}
    else:
        weights = {"w1": w * d, "wc": w * (1 - d)} | ({"w0": w * (1 - d) * odds} if scored else {})
    weights |= {"pp": w * p * (1 - p)} if scored else {}
    found: dict[tuple, tuple[float, int]] = {}
    params: dict[tuple, dict] = {}
    for key, (n, m) in _moments(rows, weights, k).items():
        try:
            if any(m[name].s <= 0 for name in weights):
                raise ValueError("no treated or no control rows")
            att, values = (_cross_cell if cross else _panel_cell)(method, m, k)
            if not np.isfinite(att):
                raise ValueError("not finite")
            found[key], params[key] = (float(att), n), values
        except (ValueError, np.linalg.LinAlgError) as e:
            errors[key] = str(e)
    if not params:
        return Estimates({}, None, errors)
    names = [n for n in next(iter(params.values())) if any(np.any(v[n]) for v in params.values())]
    met = _with(rows, parameters(rows, params, names))
    has = set(names)
    col = lambda n: F.col(f"`{n}`") if n in has else F.lit(0.0)
    xd = lambda n: dot(x, F.col(n), k) if n in has else F.lit(0.0)
    terms: list[Column] = []
    if cross:
        for s, on in side.items():
            r, plus = y - xd(f"b{s}"), 1.0 if s == "1" else -1.0
            terms.append(plus * w * d * on * (r - col(f"a1_{s}")) * col(f"i1_{s}"))
            if f"i0_{s}" in has:
                terms.append(-plus * w * (1 - d) * on * odds * (r - col(f"a0_{s}")) * col(f"i0_{s}"))
            if f"v{s}" in has:
                terms.append(w * (1 - d) * on * (y - xd(f"c{s}")) * xd(f"v{s}"))
            if f"r{s}" in has:
                terms.append(w * d * on * (y - xd(f"h{s}")) * xd(f"r{s}"))
            terms.append(w * d * on * (xd(f"e{s}") + col(f"f{s}")) + w * (1 - d) * on * col(f"l{s}"))
        terms += [w * d * (xd("q") + col("z")), col("const")]
    else:
        r = y - xd("b")
        terms.append(w * d * (r - col("a1")) * col("i1"))
        if "i0" in has:
            terms.append(-w * (1 - d) * odds * (r - col("a0")) * col("i0"))
        if "v" in has:
            terms.append(w * (1 - d) * r * xd("v"))
    if "u" in has:
        terms.append(w * (d - p) * xd("u"))
    psi = terms[0]
    for term in terms[1:]:
        psi = psi + term
    return Estimates(found, met.select(*KEY, "unit", psi.alias("psi")), errors)


def estimate_custom(rows: DataFrame, k: int, function: Callable, cross: bool) -> DataFrame:
    """sample, cell_id, unit, att, n_sample, psi from a caller's function(endog, exog, treated, weights, post) that returns
    {"att", "influence_func"}: a cell's rows meet in one task, as its contract asks."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        names = ["sample", "cell_id", "unit", "att", "n_sample", "psi", "error"]
        post = f["post"].to_numpy() if cross else None
        try:
            got = function(endog=f["y"].to_numpy(), exog=np.stack(f["x"].to_list()), treated=f["d"].to_numpy(), weights=f["w"].to_numpy(), post=post)
            out = pd.DataFrame({"unit": f["unit"], "psi": np.asarray(got["influence_func"], dtype=float).ravel()})
            out["att"], out["error"] = float(got["att"]), None
        except Exception as e:  # noqa: BLE001  a cell's failure is its result
            out = pd.DataFrame({"unit": f["unit"].head(1), "psi": [None], "att": [None], "error": [str(e)]})
        out["sample"], out["cell_id"], out["n_sample"] = key[0], key[1], len(f)
        return out[names]

    kinds = dict(rows.dtypes)
    return rows.groupBy(*KEY).applyInPandas(run, f"sample {kinds['sample']}, cell_id {kinds['cell_id']}, unit {kinds['unit']}, att double, n_sample long, psi double, error string")
