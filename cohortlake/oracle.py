"""DuckDB SQL that states what each query returns, built from the definitions and independent of the Spark plans.

With a covariate that has a mean of its own in each of its values, every estimator has a closed form in cell means: the
propensity is the treated share and the regression the mean, value by value.
"""

from __future__ import annotations

COHORT = "CASE WHEN {k} % 4 = 0 THEN NULL ELSE (1996 + {k} % 4)::INT END"

F1 = f"""p0 AS (
  SELECT l_suppkey AS e, year(l_shipdate)::INT AS t, {COHORT.format(k="l_suppkey")} AS g, avg(l_extendedprice)::DOUBLE AS y, avg(l_quantity)::DOUBLE AS q,
         (l_suppkey // 4 % 2)::INT AS s, (l_suppkey // 8 % 2)::INT AS x, (1 + (l_suppkey % 5) / 10.0)::DOUBLE AS w
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"""
F2 = f"""p0 AS (
  SELECT o_custkey AS e, year(o_orderdate)::INT AS t, {COHORT.format(k="o_custkey")} AS g, avg(o_totalprice)::DOUBLE AS y, (o_custkey // 8 % 2)::INT AS x, 1.0::DOUBLE AS w, 0 AS s
  FROM orders GROUP BY o_custkey, year(o_orderdate))"""
F3 = f"""p0 AS (
  SELECT o_orderkey AS e, year(o_orderdate)::INT AS t, {COHORT.format(k="c_nationkey")} AS g, o_totalprice::DOUBLE AS y, (o_custkey // 8 % 2)::INT AS x, 1.0::DOUBLE AS w, 0 AS s
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
#: Weeks are numbered from 1000.
F4 = """first AS (SELECT min(date_trunc('week', ts)) AS w0 FROM events), p0 AS (
  SELECT user_id AS e, (1000 + date_diff('day', any_value(w0), date_trunc('week', ts)) // 7)::INT AS t,
         (CASE WHEN user_id % 4 > 0 THEN 1000 + date_diff('day', any_value(w0), DATE '2024-01-01') // 7 + user_id % 4 END)::INT AS g, avg(value)::DOUBLE AS y, 0 AS x, 1.0::DOUBLE AS w, 0 AS s
  FROM events, first GROUP BY user_id, date_trunc('week', ts))"""
#: Always-treated entities go, and those treated after their own last time are never treated.
RULES = """spans AS (SELECT *, max(g) OVER (PARTITION BY e) AS gg, min(t) OVER (PARTITION BY e) AS a, max(t) OVER (PARTITION BY e) AS b FROM p0),
p AS (SELECT e, t, CASE WHEN gg <= b THEN gg END AS g, y, x, w, s FROM spans WHERE gg IS NULL OR gg > a)"""
PLAIN = "p AS (SELECT * FROM p0)"


def cells(anticipation: int = 0, universal: bool = False) -> str:
    pick = "b.b" if universal else "CASE WHEN t.t >= c.g THEN b.b ELSE t.prev END"
    return f"""times AS (SELECT t, lag(t) OVER (ORDER BY t) AS prev FROM (SELECT DISTINCT t FROM p)),
cohorts AS (SELECT DISTINCT g FROM p WHERE g > (SELECT min(t) FROM p) + {anticipation}),
bases AS (SELECT g, max(t) AS b FROM cohorts, times WHERE t < g - {anticipation} GROUP BY g),
cells AS (SELECT * FROM (SELECT c.g AS cg, {pick} AS base, t.t AS tt FROM cohorts c CROSS JOIN times t LEFT JOIN bases b ON b.g = c.g
          WHERE {"true" if universal else "t.prev IS NOT NULL"}) WHERE base IS NOT NULL)"""


def control(kind: str = "never", anticipation: int = 0) -> str:
    never = "{a}.g IS NULL"
    if kind == "never":
        return never
    return f"({never} OR ({{a}}.g <> cg AND {{a}}.g > greatest(tt, base) + {anticipation}))"


def panel_rows(kind: str = "never", anticipation: int = 0, x: str = "early", key: str = "1", where: str = "true") -> str:
    """i: the sample or stratum; x: of the earlier time."""
    met = control(kind, anticipation).format(a="a")
    return f"""r AS (SELECT {key} AS i, cg, base, tt, a.e, (a.g IS NOT DISTINCT FROM cg)::INT AS d, b.y - a.y AS y,
              CASE WHEN tt < base THEN b.x ELSE a.x END AS x, CASE WHEN tt < base THEN b.w ELSE a.w END AS w
       FROM cells JOIN p a ON a.t = base JOIN p b ON b.t = tt AND b.e = a.e WHERE base <> tt AND (a.g = cg OR {met}) AND {where}),
n AS (SELECT i, count(DISTINCT e) AS n FROM (SELECT {key} AS i, a.e FROM p a WHERE {where}) GROUP BY i)"""


#: Unit influences of panel rows (times n / n): all four estimators agree where x is saturated.
PANEL_PSI = """k AS (SELECT i, cg, base, tt, x, sum(w * d) AS w1, sum(w * (1 - d)) AS wc, sum(w * (1 - d) * y) / sum(w * (1 - d)) AS m FROM r GROUP BY ALL),
h AS (SELECT r.*, k.w1 AS w1x, k.wc AS wcx, k.m FROM r JOIN k USING (i, cg, base, tt, x)),
att AS (SELECT i, cg, base, tt, sum(w * d * (y - m)) / sum(w * d) AS att, sum(w * d) AS w1 FROM h GROUP BY ALL),
psi AS (SELECT h.i, h.cg, h.base, h.tt, h.e, n.n * (w * d * (y - m - att) - w * (1 - d) * (y - m) * w1x / wcx) / att.w1 AS psi
        FROM h JOIN att USING (i, cg, base, tt) JOIN n USING (i))"""
SE = "se AS (SELECT psi.i, cg, base, tt, sqrt(sum(psi * psi)) / any_value(n.n) AS se FROM psi JOIN n USING (i) GROUP BY ALL)"
OUT = "SELECT cg AS cohort, base AS base_period, tt AS time, round(att, 4) AS att, round(se, 4) AS std_error FROM att JOIN se USING (i, cg, base, tt)"


def build(*parts: str, out: str = OUT) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + out


def panel(fixture: str = F1, rules: str = PLAIN, kind: str = "never", anticipation: int = 0, saturated: bool = False, weighted: bool = False, out: str = OUT, key: str = "1", where: str = "true", more: tuple[str, ...] = ()) -> str:
    sql = build(fixture, rules, cells(anticipation), panel_rows(kind, anticipation, key=key, where=where), PANEL_PSI, SE, *more, out=out)
    if not saturated:
        sql = sql.replace("CASE WHEN tt < base THEN b.x ELSE a.x END AS x", "0 AS x")
    if not weighted:
        sql = sql.replace("CASE WHEN tt < base THEN b.w ELSE a.w END AS w", "1.0::DOUBLE AS w")
    return sql


def universal() -> str:
    out = """SELECT cg AS cohort, base AS base_period, tt AS time, round(CASE WHEN base = tt THEN 0 ELSE att END, 4) AS att, round(se, 4) AS std_error
FROM cells LEFT JOIN att USING (cg, base, tt) LEFT JOIN se USING (cg, base, tt)"""
    return panel(out=out).replace(cells(), cells(universal=True))


def dated() -> str:
    day = lambda c: f"strftime((SELECT w0 FROM first) + to_days(7 * ({c} - 1000)::INT), '%Y-%m-%d')"
    out = f"SELECT {day('cg')} AS cohort, {day('base')} AS base_period, {day('tt')} AS time, round(att, 4) AS att, round(se, 4) AS std_error FROM att JOIN se USING (i, cg, base, tt)"
    return panel(F4, RULES, out=out)


#: One covariate x (q) besides the constant: two normal equations.
def regression() -> str:
    return build(
        F1, PLAIN, cells(), panel_rows().replace("b.x ELSE a.x END", "b.q ELSE a.q END").replace("CASE WHEN tt < base THEN b.w ELSE a.w END AS w", "1.0::DOUBLE AS w"),
        """c AS (SELECT cg, base, tt, count(*) AS n0, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM r WHERE d = 0 GROUP BY ALL),
b AS (SELECT *, (n0 * sxy - sx * sy) / (n0 * sxx - sx * sx) AS b1, (sy * sxx - sx * sxy) / (n0 * sxx - sx * sx) AS b0, n0 * sxx - sx * sx AS det FROM c),
t AS (SELECT cg, base, tt, count(*) AS n1, avg(x) AS mx, avg(y) AS my FROM r WHERE d = 1 GROUP BY ALL),
k AS (SELECT *, my - b0 - b1 * mx AS att, -(sxx - sx * mx) / det AS v0, -(n0 * mx - sx) / det AS v1 FROM b JOIN t USING (cg, base, tt)),
psi AS (SELECT cg, base, tt, att, d * (y - b0 - b1 * x - att) / n1 + (1 - d) * (y - b0 - b1 * x) * (v0 + v1 * x) AS psi FROM r JOIN k USING (cg, base, tt))""",
        out="SELECT cg AS cohort, base AS base_period, tt AS time, round(any_value(att), 4) AS att, round(sqrt(sum(psi * psi)), 4) AS std_error FROM psi GROUP BY cg, base, tt",
    )


def delta() -> str:
    """The change of q as the only covariate."""
    return regression().replace("CASE WHEN tt < base THEN b.q ELSE a.q END AS x", "b.q - a.q AS x")


def cross_rows(kind: str = "never", anticipation: int = 0) -> str:
    met = control(kind, anticipation).format(a="a")
    return f"""r AS (SELECT 1 AS i, cg, base, tt, a.e, (a.g IS NOT DISTINCT FROM cg)::INT AS d, (a.t = tt)::INT AS o, a.y, a.x, a.w
       FROM cells JOIN p a ON a.t = base OR a.t = tt WHERE base <> tt AND (a.g = cg OR {met}))"""


#: Weights by value of x: treated and control at either time, and the means of y there.
_STATS = """k AS (SELECT cg, base, tt, x, sum(w * d) AS wd, sum(w * (1 - d)) AS wc, sum(w * d * o) AS t1, sum(w * d * (1 - o)) AS t0, sum(w * (1 - d) * o) AS c1, sum(w * (1 - d) * (1 - o)) AS c0,
             sum(w * d * o * y) / sum(w * d * o) AS h1, sum(w * d * (1 - o) * y) / sum(w * d * (1 - o)) AS h0,
             sum(w * (1 - d) * o * y) / sum(w * (1 - d) * o) AS m1, sum(w * (1 - d) * (1 - o) * y) / sum(w * (1 - d) * (1 - o)) AS m0 FROM r GROUP BY ALL),
a AS (SELECT cg, base, tt, sum(wd) AS wd, sum(t1) AS t1, sum(t0) AS t0, sum(t1 * h1) / sum(t1) AS y1, sum(t0 * h0) / sum(t0) AS y0,
             sum(c1 * wd / wc) AS o1, sum(c0 * wd / wc) AS o0, sum(c1 * wd / wc * m1) / sum(c1 * wd / wc) AS z1, sum(c0 * wd / wc * m0) / sum(c0 * wd / wc) AS z0,
             sum(wd * (m1 - m0)) / sum(wd) AS drift, sum(t1 * (h1 - m1)) / sum(t1) AS g1, sum(t0 * (h0 - m0)) / sum(t0) AS g0,
             sum(wd * (h1 - m1)) / sum(wd) AS f1, sum(wd * (h0 - m0)) / sum(wd) AS f0, sum(wd) + sum(wc) AS nn, sum(t1 + c1) AS l1, sum(t0 + c0) AS l0 FROM k GROUP BY ALL),
h AS (SELECT r.*, k.wd AS kd, k.wc AS kc, k.t1 AS kt1, k.t0 AS kt0, k.c1 AS kc1, k.c0 AS kc0, k.h1, k.h0, k.m1, k.m0,
             a.wd AS wd, a.t1, a.t0, a.y1, a.y0, a.o1, a.o0, a.z1, a.z0, a.drift, a.g1, a.g0, a.f1, a.f0, a.nn, a.l1, a.l0, k.wd / k.wc AS odds, k.wd / (k.wd + k.wc) AS ps
      FROM r JOIN k USING (cg, base, tt, x) JOIN a USING (cg, base, tt))"""
_REG = ("y1 - y0 - drift", """w*d*o*(y-y1)/t1 - w*d*(1-o)*(y-y0)/t0 - w*d*(m1-m0-drift)/wd - w*(1-d)*o*(y-m1)*kd/kc1/wd + w*(1-d)*(1-o)*(y-m0)*kd/kc0/wd""")
#: The share of the propensity's estimation error: w (d - p) / (sum of w p (1 - p) at x) times the derivative at x.
_PS = "w*(d-ps)/(kd*kc/(kd+kc))"
_STD = ("y1 - y0 - (z1 - z0)", f"""w*d*o*(y-y1)/t1 - w*d*(1-o)*(y-y0)/t0 - w*(1-d)*o*odds*(y-z1)/o1 + w*(1-d)*(1-o)*odds*(y-z0)/o0
  - {_PS}*(kc1*odds*(m1-z1)/o1 - kc0*odds*(m0-z0)/o0)""")
_IPW = ("nn * (y1*t1/l1 - y0*t0/l0 - (z1*o1/l1 - z0*o0/l0)) / wd", f"""nn*(w*d*o*y/l1 - w*d*(1-o)*y/l0 - w*(1-d)*o*odds*y/l1 + w*(1-d)*(1-o)*odds*y/l0)/wd + att/nn - w*d*att/wd
  - w*o*nn*(y1*t1 - z1*o1)/l1/wd/l1 + w*(1-o)*nn*(y0*t0 - z0*o0)/l0/wd/l0 - {_PS}*nn*(kc1*odds*m1/l1 - kc0*odds*m0/l0)/wd""")
_DR_CORE = """w*d*o*(y-m1-g1)/t1 - w*d*(1-o)*(y-m0-g0)/t0 - w*(1-d)*o*odds*(y-m1)/o1 + w*(1-d)*(1-o)*odds*(y-m0)/o0
  + w*d*((h1-m1)-(h0-m0)-(f1-f0))/wd - w*d*o*(h1-m1-g1)/t1 + w*d*(1-o)*(h0-m0-g0)/t0"""
_DR = ("f1 - f0", f"""{_DR_CORE}
  + w*(1-d)*o*(y-m1)*((kc1*odds/o1 - kt1/t1) - (kd/wd - kt1/t1))/kc1 + w*(1-d)*(1-o)*(y-m0)*((kc0*odds/o0 - kt0/t0) + (kd/wd - kt0/t0))/kc0
  + w*d*o*(y-h1)*(kd/wd - kt1/t1)/kt1 - w*d*(1-o)*(y-h0)*(kd/wd - kt0/t0)/kt0""")
_IPT = ("f1 - f0", _DR_CORE)
CROSS = {"reg": _REG, "std_ipw": _STD, "ipw": _IPW, "dr": _DR, "dr-ipt": _IPT}


def cross(method: str, fixture: str = F3, rules: str = PLAIN, saturated: bool = True, by_unit: bool = False) -> str:
    """Repeated cross-sections; by_unit: influences are summed by entity and scaled by entities over rows."""
    att, psi = CROSS[method]
    total = "(SELECT count(DISTINCT e) FROM p)" if by_unit else "(SELECT count(*) FROM p)"
    psi_of = psi.replace("att", f"({att})")
    unit = "SELECT cg, base, tt, e, sum(psi) AS psi FROM u GROUP BY ALL"
    sql = build(
        fixture, rules, cells(), cross_rows(), _STATS, f"u AS (SELECT cg, base, tt, e, {att} AS att, {psi_of} AS psi FROM h)", f"s AS ({unit})",
        "att AS (SELECT cg, base, tt, any_value(att) AS att FROM u GROUP BY ALL)", "se AS (SELECT cg, base, tt, sqrt(sum(psi * psi)) AS se FROM s GROUP BY ALL)",
        out=f"SELECT cg AS cohort, base AS base_period, tt AS time, round(att, 4) AS att, round(se, 4) AS std_error FROM att JOIN se USING (cg, base, tt) WHERE {total} > 0",
    )
    return sql if saturated else sql.replace("a.y, a.x, a.w", "a.y, 0 AS x, a.w")


#: Aggregation of cells: one row for each (i, v); load: the term of estimated shares, 0 where cells have fixed weights.
def _agg(kind: str, overall: bool) -> str:
    """q: weights of cells in each row; z: how a cohort loads on a row."""
    post = "tt >= cg"
    if kind == "cohort":
        q = f"q AS (SELECT i, cg AS v, cg, base, tt, 1.0 / count(*) OVER (PARTITION BY i, cg) AS wt FROM att WHERE {post}), z AS (SELECT i, cg AS v, cg, 0.0 AS ld FROM att WHERE false)"
    else:
        value = {"simple": "0", "event": "tt - cg", "time": "tt"}[kind]
        where = "true" if kind == "event" else post
        q = f"""q AS (SELECT i, {value} AS v, cg, base, tt, sh / sum(sh) OVER (PARTITION BY i, {value}) AS wt, att, sum(sh) OVER (PARTITION BY i, {value}) AS ss FROM att JOIN share USING (i, cg) WHERE {where}),
z AS (SELECT q.i, q.v, q.cg, sum((q.att - m.att) / q.ss) AS ld FROM q JOIN (SELECT i, v, sum(wt * att) AS att FROM q GROUP BY i, v) m USING (i, v) GROUP BY q.i, q.v, q.cg)"""
    if overall and kind in ("event", "time"):
        keep = "v >= 0" if kind == "event" else "true"
        q += f""", c AS (SELECT i, count(DISTINCT v) AS c FROM q WHERE {keep} GROUP BY i),
q2 AS (SELECT i, 0 AS v, cg, base, tt, wt / c AS wt FROM q JOIN c USING (i) WHERE {keep}), z2 AS (SELECT i, 0 AS v, cg, sum(ld / c) AS ld FROM z JOIN c USING (i) WHERE {keep} GROUP BY i, cg)"""
    elif overall and kind == "cohort":
        q += """, c AS (SELECT DISTINCT i, v, sh / (SELECT sum(sh) FROM share s2 WHERE s2.i = q.i AND s2.cg IN (SELECT cg FROM q q3 WHERE q3.i = q.i)) AS wv, (SELECT sum(sh) FROM share s2 WHERE s2.i = q.i AND s2.cg IN (SELECT cg FROM q q3 WHERE q3.i = q.i)) AS ss
      FROM q JOIN share USING (i, cg)),
ga AS (SELECT q.i, q.v, sum(wt * att) AS att FROM q JOIN att USING (i, cg, base, tt) GROUP BY q.i, q.v), al AS (SELECT i, sum(wv * att) AS att FROM c JOIN ga USING (i, v) GROUP BY i),
q2 AS (SELECT i, 0 AS v, cg, base, tt, wt * wv AS wt FROM q JOIN c USING (i, v)), z2 AS (SELECT i, 0 AS v, c.v AS cg, (ga.att - al.att) / ss AS ld FROM c JOIN ga USING (i, v) JOIN al USING (i))"""
    else:
        q += ", q2 AS (SELECT i, v, cg, base, tt, wt FROM q), z2 AS (SELECT * FROM z)"
    return q + """,
aa AS (SELECT q2.i, q2.v, sum(wt * att) AS att FROM q2 JOIN att USING (i, cg, base, tt) GROUP BY q2.i, q2.v),
ap AS (SELECT i, v, e, sum(psi) AS psi FROM (SELECT q2.i, q2.v, psi.e, wt * psi AS psi FROM q2 JOIN psi USING (i, cg, base, tt) UNION ALL SELECT z2.i, z2.v, un.e, ld FROM z2 JOIN un ON un.i = z2.i AND un.g = z2.cg) GROUP BY ALL),
ae AS (SELECT ap.i, v, sqrt(sum(psi * psi)) / any_value(n.n) AS se FROM ap JOIN n USING (i) GROUP BY ap.i, v)"""


def _units(key: str, where: str) -> str:
    return f"un AS (SELECT DISTINCT {key} AS i, a.e, a.g FROM p a WHERE {where}), share AS (SELECT i, g AS cg, count(*) / any_value(n.n) AS sh FROM un JOIN n USING (i) WHERE g IS NOT NULL GROUP BY i, g)"


FIELDS = {"simple": "", "event": "v::INT AS relative_period, ", "cohort": "v::INT AS cohort, ", "time": "v::INT AS time, "}


def aggregated(kind: str, overall: bool = False, key: str = "1", label: str = "", where: str = "true", kind_of: str = "never") -> str:
    field = "" if overall else FIELDS[kind]
    return panel(key=key, where=where, kind=kind_of, more=(_units(key, where), _agg(kind, overall)), out=f"SELECT {label}{field}round(att, 4) AS att, round(se, 4) AS std_error FROM aa JOIN ae USING (i, v)")


def strata_rows(sql: str) -> str:
    """Treated rows of a stratum's cells are that stratum's; never treated rows of any stratum are controls."""
    return sql.replace("(a.g = cg OR a.g IS NULL)", "((a.g = cg AND a.s = st) OR a.g IS NULL)").replace("FROM cells JOIN p a", "FROM (SELECT * FROM cells CROSS JOIN (SELECT DISTINCT s AS st FROM p)) cells JOIN p a")


def by_strata(kind: str, label: str = "i AS stratum, ", out: str | None = None, more: tuple[str, ...] = ()) -> str:
    sql = panel(key="st", more=("un AS (SELECT DISTINCT a.s AS i, a.e, a.g FROM p a)", "share AS (SELECT i, g AS cg, count(*) / any_value(n.n) AS sh FROM un JOIN n USING (i) WHERE g IS NOT NULL GROUP BY i, g)", _agg(kind, False), *more),
                out=out or f"SELECT {label}{FIELDS[kind]}round(att, 4) AS att, round(se, 4) AS std_error FROM aa JOIN ae USING (i, v)")
    sql = strata_rows(sql)
    return sql.replace("n AS (SELECT i, count(DISTINCT e) AS n FROM (SELECT st AS i, a.e FROM p a WHERE true) GROUP BY i)", "n AS (SELECT s AS i, (SELECT count(DISTINCT e) FROM p) AS n FROM (SELECT DISTINCT s FROM p))")


def difference_samples(kind: str) -> str:
    """Units of both samples, without rescaling."""
    out = f"""SELECT x.v::INT AS {'relative_period' if kind == 'event' else kind}, round(x.att - z.att, 4) AS att,
       round(sqrt((SELECT sum(psi * psi) FROM ap WHERE ap.v = x.v)) / (SELECT sum(n) FROM n), 4) AS std_error
FROM aa x JOIN aa z ON x.v = z.v AND x.i = 0 AND z.i = 1"""
    return panel(key="a.s", more=(_units("a.s", "true"), _agg(kind, False)), out=out)


def difference_strata(kind: str) -> str:
    out = f"""SELECT x.v::INT AS {'relative_period' if kind == 'event' else kind}, round(x.att - z.att, 4) AS att,
       round((SELECT sqrt(sum(s * s)) FROM (SELECT sum(CASE i WHEN 0 THEN psi ELSE -psi END) AS s FROM ap WHERE ap.v = x.v GROUP BY e)) / (SELECT any_value(n) FROM n), 4) AS std_error
FROM aa x JOIN aa z ON x.v = z.v AND x.i = 0 AND z.i = 1"""
    return by_strata(kind, out=out)


def difference_both(kind: str) -> str:
    """Stratum 0 of the sample h = 0 less stratum 1 of the sample h = 1; i is 10 h + stratum."""
    out = f"""SELECT 'h = 0, 0 - h = 1, 1' AS difference_between, x.v::INT AS {'relative_period' if kind == 'event' else kind}, round(x.att - z.att, 4) AS att,
       round(sqrt((SELECT sum(psi * psi) FROM ap WHERE ap.v = x.v AND i IN (0, 11))) / (SELECT sum(n) FROM n WHERE i IN (0, 11)), 4) AS std_error
FROM aa x JOIN aa z ON x.v = z.v AND x.i = 0 AND z.i = 11"""
    share = "share AS (SELECT i, g AS cg, count(*) / any_value(n.n) AS sh FROM un JOIN n USING (i) WHERE g IS NOT NULL GROUP BY i, g)"
    fixture = F1.replace("(1 + (l_suppkey", "(l_suppkey % 3 = 0)::INT AS h, (1 + (l_suppkey")
    sql = strata_rows(panel(fixture, key="(a.h * 10 + st)", more=("un AS (SELECT DISTINCT a.h * 10 + a.s AS i, a.e, a.g FROM p a)", share, _agg(kind, False)), out=out))
    counted = "n AS (SELECT h * 10 + s AS i, any_value(m) AS n FROM (SELECT DISTINCT h, s FROM p) JOIN (SELECT h, count(DISTINCT e) AS m FROM p GROUP BY h) USING (h) GROUP BY h, s)"
    return sql.replace("n AS (SELECT i, count(DISTINCT e) AS n FROM (SELECT (a.h * 10 + st) AS i, a.e FROM p a WHERE true) GROUP BY i)", counted)


def difference_cells() -> str:
    out = """SELECT x.cg AS cohort, x.base AS base_period, x.tt AS time, round(x.att - z.att, 4) AS att,
       round(sqrt((SELECT sum(psi * psi) FROM psi s WHERE s.cg = x.cg AND s.base = x.base AND s.tt = x.tt)) / (SELECT sum(n) FROM n), 4) AS std_error
FROM att x JOIN att z ON x.cg = z.cg AND x.base = z.base AND x.tt = z.tt AND x.i = 0 AND z.i = 1"""
    return panel(key="a.s", out=out)


def _draws(draws: int, seed: int) -> str:
    """The sign of draw b is bit (b - 1) % 128 of the MD5 of unit, (b - 1) // 128 and seed."""
    bit = f"('0x' || substr(md5(concat_ws('|', u, (b - 1) // 128, {seed})), 1 + (b - 1) % 128 // 4, 1))::INT // (8 >> ((b - 1) % 4)::INT) % 2"
    return f"dr AS (SELECT v, b, sum(psi * (2 * ({bit}) - 1)) / any_value(bn.n) * sqrt(any_value(bn.n)) AS m FROM bu, bn, range(1, {draws + 1}) t(b) GROUP BY v, b)"


def bootstrap(draws: int, seed: int, clusters: bool = False, band: bool = False) -> str:
    """Event effects under random signs. clusters: mean influence of each nation's suppliers."""
    unit = """cl AS (SELECT s_suppkey AS e, s_nationkey AS c FROM supplier WHERE s_suppkey IN (SELECT e FROM p)), cn AS (SELECT c, count(*) AS m FROM cl GROUP BY c),
bu AS (SELECT v, cl.c AS u, sum(psi) / any_value(m) AS psi FROM ap JOIN cl USING (e) JOIN cn USING (c) GROUP BY v, cl.c), bn AS (SELECT count(*) AS n FROM cn)""" if clusters else "bu AS (SELECT v, e AS u, psi FROM ap), bn AS (SELECT n FROM n)"
    z = 1.3489795003921634
    more = f"""{unit},
{_draws(draws, seed)},
sg AS (SELECT v, (quantile_disc(m, 0.75) - quantile_disc(m, 0.25)) / {z} AS sg FROM dr GROUP BY v),
cv AS (SELECT quantile_disc(mm, 0.95) AS cv FROM (SELECT b, max(abs(m / sg)) AS mm FROM dr JOIN sg USING (v) WHERE sg > 0 GROUP BY b))"""
    columns = "v::INT AS relative_period, round(att, 4) AS att, round(sg / sqrt(n), 4) AS std_error"
    columns += ", round(att - cv * sg / sqrt(n), 4) AS lower, round(att + cv * sg / sqrt(n), 4) AS upper" if band else ""
    return panel(more=(_units("1", "true"), _agg("event", False), more), out=f"SELECT {columns} FROM aa JOIN sg USING (v), cv, bn").replace("FROM aa JOIN sg USING (v), cv, bn", "FROM aa JOIN sg USING (v) CROSS JOIN cv CROSS JOIN bn")


def wald() -> str:
    """n a' V^-1 a over the cells before treatment, by elimination column by column, and the chi-square tail by its series."""
    more = """pre AS (SELECT row_number() OVER (ORDER BY cg, tt) AS i, cg, base, tt, att FROM att WHERE tt < cg),
ps AS (SELECT pre.i, e, psi FROM psi JOIN pre USING (cg, base, tt)),
sys(k, m) AS MATERIALIZED (SELECT 0, list(row ORDER BY i) FROM (
    SELECT pre.i, list_append((SELECT list(v ORDER BY j) FROM (SELECT b.i AS j, sum(a.psi * b.psi) / (SELECT any_value(n) FROM n) AS v FROM ps a JOIN ps b ON a.e = b.e WHERE a.i = pre.i GROUP BY b.i)), pre.att) AS row FROM pre)),
el AS (SELECT * FROM (WITH RECURSIVE r(k, m) AS (
    SELECT k, m FROM sys UNION ALL
    SELECT k + 1, [CASE WHEN i = k + 1 THEN [x / m[k + 1][k + 1] for x in m[i]]
                   ELSE [m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] for j in range(1, len(m) + 2)] END for i in range(1, len(m) + 1)]
    FROM r WHERE k < len(m)) SELECT m FROM r ORDER BY k DESC LIMIT 1)),
w AS (SELECT (SELECT any_value(n) FROM n) * sum(att * m[i][len(m) + 1]) AS w, count(*) AS q FROM pre, el)"""
    tail = "1 - (SELECT sum(exp((q / 2.0 + t.k) * ln(w / 2) - w / 2 - lgamma(q / 2.0 + t.k + 1))) FROM range(0, 2000) t(k))"
    return panel(more=(more,), out=f"SELECT round(w, 4) AS wald_stat, q::INT AS df, round({tail}, 4) AS p_value FROM w")


def bands() -> str:
    z = 1.959963984540054
    out = f"""SELECT cohort, base_period, time, att, std_error, lower, upper, CASE WHEN lo * hi > 0 THEN '*' ELSE '' END AS zero_not_in_cband, n_sample, n_total FROM (
SELECT cg AS cohort, base AS base_period, tt AS time, round(att, 4) AS att, round(se, 4) AS std_error, att - {z} * se AS lo, att + {z} * se AS hi, round(att - {z} * se, 4) AS lower, round(att + {z} * se, 4) AS upper,
       (SELECT count(*) FROM r WHERE r.cg = att.cg AND r.base = att.base AND r.tt = att.tt) AS n_sample, (SELECT any_value(n) FROM n) AS n_total
FROM att JOIN se USING (i, cg, base, tt))"""
    return panel(out=out)


def weighted_aggregate() -> str:
    """Shares of cohorts are sums of weights; cells are weighted too (the covariate has two values)."""
    units = "un AS (SELECT 1 AS i, e, any_value(g) AS g, any_value(w) AS w FROM p GROUP BY e), share AS (SELECT i, g AS cg, sum(w) / any_value(n.n) AS sh FROM un JOIN n USING (i) WHERE g IS NOT NULL GROUP BY i, g)"
    sql = panel(saturated=True, weighted=True, more=(units, _agg("event", False)), out="SELECT v::INT AS relative_period, round(att, 4) AS att, round(se, 4) AS std_error FROM aa JOIN ae USING (i, v)")
    return sql.replace("SELECT z2.i, z2.v, un.e, ld FROM z2", "SELECT z2.i, z2.v, un.e, un.w * ld FROM z2")


def difference_rescaled() -> str:
    """The error of a difference of independent samples."""
    out = """SELECT x.v::INT AS relative_period, round(x.att - z.att, 4) AS att, round(sqrt(a.se * a.se + b.se * b.se), 4) AS std_error
FROM aa x JOIN aa z ON x.v = z.v AND x.i = 0 AND z.i = 1 JOIN ae a ON a.v = x.v AND a.i = 0 JOIN ae b ON b.v = x.v AND b.i = 1"""
    return panel(key="a.s", more=(_units("a.s", "true"), _agg("event", False)), out=out)


def difference_clusters(draws: int, seed: int) -> str:
    """Two strata: a supplier's influence on one less that on the other, as means of nations, under random signs."""
    z = 1.3489795003921634
    more = f"""cl AS (SELECT s_suppkey AS e, s_nationkey AS c FROM supplier WHERE s_suppkey IN (SELECT e FROM p)), cn AS (SELECT c, count(*) AS m FROM cl GROUP BY c),
df AS (SELECT v, e, sum(CASE i WHEN 0 THEN psi ELSE -psi END) AS psi FROM ap WHERE v IN (SELECT v FROM ap WHERE i = 0) AND v IN (SELECT v FROM ap WHERE i = 1) GROUP BY v, e),
bu AS (SELECT v, cl.c AS u, sum(psi) / any_value(m) AS psi FROM df JOIN cl USING (e) JOIN cn USING (c) GROUP BY v, cl.c), bn AS (SELECT count(*) AS n FROM cn),
{_draws(draws, seed)},
sg AS (SELECT v, (quantile_disc(m, 0.75) - quantile_disc(m, 0.25)) / {z} AS sg FROM dr GROUP BY v)"""
    out = "SELECT x.v::INT AS relative_period, round(x.att - z.att, 4) AS att, round(sg / sqrt(n), 4) AS std_error FROM aa x JOIN aa z ON x.v = z.v AND x.i = 0 AND z.i = 1 JOIN sg ON sg.v = x.v CROSS JOIN bn"
    return by_strata("event", out=out, more=(more,))


def continuous(newton: int = 30) -> str:
    """Normalised inverse-probability weights with a continuous covariate: the logit by Newton steps, two normal equations each."""
    return build(
        F1, PLAIN, cells(), panel_rows().replace("b.x ELSE a.x END", "b.q ELSE a.q END").replace("CASE WHEN tt < base THEN b.w ELSE a.w END AS w", "1.0::DOUBLE AS w"),
        f"""gm AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE g(k, cg, base, tt, a, b) AS (
    SELECT 0, cg, base, tt, 0.0::DOUBLE, 0.0::DOUBLE FROM r GROUP BY cg, base, tt UNION ALL
    SELECT k + 1, cg, base, tt, a + (s0 * hxx - s1 * hx) / (h * hxx - hx * hx), b + (s1 * h - s0 * hx) / (h * hxx - hx * hx)
    FROM (SELECT k, cg, base, tt, any_value(a) AS a, any_value(b) AS b, sum(d - p) AS s0, sum((d - p) * x) AS s1, sum(p * (1 - p)) AS h, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p) * x * x) AS hxx
          FROM (SELECT g.*, r.d, r.x, 1 / (1 + exp(-(g.a + g.b * r.x))) AS p FROM g JOIN r USING (cg, base, tt)) GROUP BY k, cg, base, tt) WHERE k < {newton})
  SELECT cg, base, tt, a, b FROM g WHERE k = {newton})),
h AS (SELECT r.*, exp(gm.a + gm.b * x) AS odds, 1 / (1 + exp(-(gm.a + gm.b * x))) AS p FROM r JOIN gm USING (cg, base, tt)),
m AS (SELECT cg, base, tt, sum(d) AS w1, sum(d * y) / sum(d) AS e1, sum((1 - d) * odds) AS w0, sum((1 - d) * odds * y) / sum((1 - d) * odds) AS e0,
             sum(p * (1 - p)) AS i0, sum(p * (1 - p) * x) AS ix, sum(p * (1 - p) * x * x) AS ixx FROM h GROUP BY ALL),
c AS (SELECT cg, base, tt, sum((1 - d) * odds * (y - e0)) AS c0, sum((1 - d) * odds * (y - e0) * x) AS c1 FROM h JOIN m USING (cg, base, tt) GROUP BY ALL),
psi AS (SELECT cg, base, tt, e1 - e0 AS att, d * (y - e1) / w1 - ((1 - d) * odds * (y - e0) + (d - p) * ((ixx * c0 - ix * c1) + x * (i0 * c1 - ix * c0)) / (i0 * ixx - ix * ix)) / w0 AS psi
        FROM h JOIN m USING (cg, base, tt) JOIN c USING (cg, base, tt))""",
        out="SELECT cg AS cohort, base AS base_period, tt AS time, round(any_value(att), 4) AS att, round(sqrt(sum(psi * psi)), 4) AS std_error FROM psi GROUP BY cg, base, tt",
    )


def uniform(seed: int, *key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(key)})), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


def normal(seed: int, *key: str) -> str:
    return f"sqrt(-2 * ln(1 - {uniform(seed, *key)})) * cos(2 * {3.141592653589793} * {uniform(seed + 7919, *key)})"


def simulated(n: int = 200) -> str:
    """The generator's panel by its defaults: three cohorts of 1902, 1904 and 1906 by thirds of four in five entities, intensities 0.5, 5.25 and 10."""
    return f"""WITH en AS (SELECT id, {uniform(1, 'id')} AS u, {normal(2, 'id')} AS level FROM range({n}) t(id)),
co AS (SELECT *, CASE WHEN u < 0.8::DOUBLE / 3 THEN 1902 WHEN u < 1.6::DOUBLE / 3 THEN 1904 WHEN u < 0.8 THEN 1906 END::INT AS cohort FROM en),
ro AS (SELECT *, (1900 + k)::INT AS time, CASE cohort WHEN 1902 THEN 0.5 WHEN 1904 THEN 5.25 WHEN 1906 THEN 10 END::DOUBLE AS intensity, {normal(100, 'id', '1900 + k')} AS x0 FROM co, range(8) t(k)),
ef AS (SELECT *, CASE WHEN time > cohort THEN 10 * intensity * (time - cohort) / 10.0 ELSE 0 END::DOUBLE AS effect FROM ro)
SELECT 'e' || id AS entity, time, coalesce(cohort, 0) AS cohort, coalesce(round(intensity, 6), 0) AS intensity, round(effect, 6) AS effect, round(x0, 6) AS x0,
       round(level + 0.1 * (time - 1900) + effect + 10 * {normal(6, 'id', 'time')} + x0, 6) AS y, round(0.5 + {uniform(8, 'id')}, 6) AS weights FROM ef"""
