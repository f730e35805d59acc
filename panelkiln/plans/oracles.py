"""DuckDB SQL for the registered queries that have a closed form. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from panelkiln.plans.queries import CHARACTERISTICS, MACROS
from panelkiln.sources.schema import MACROS as MACRO_NAMES

_SHARE = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"
_P = "o_orderpriority = '{}'"
_MONTHLY = [
    "avg(o_totalprice) / 1e6", _SHARE.format(_P.format("1-URGENT")), _SHARE.format(_P.format("2-HIGH")), _SHARE.format(_P.format("3-MEDIUM")),
    _SHARE.format(_P.format("5-LOW")) + " / 10", _SHARE.format("o_totalprice > 200000.0"), "min(o_totalprice) / 1e5", "stddev_samp(o_totalprice) / 1e6",
]
_FACTORS = {"mktrf": "1-URGENT", "smb": "2-HIGH", "hml": "3-MEDIUM", "rmw": "4-NOT SPECIFIED", "cma": "5-LOW"}

_RAW = f"""
g AS (
  SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS month, round(sum(l_extendedprice * (1 - l_discount)), 8) AS me, CAST(count(*) AS DOUBLE) AS n_lines,
    round(avg(l_discount), 8) AS disc, round(avg(l_quantity), 8) AS qty, round(avg(l_tax), 8) AS tax, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 8) AS retrate,
    round(stddev_samp(l_extendedprice), 8) AS disp
  FROM lineitem GROUP BY 1, 2
),
returns AS (SELECT permno, month, year(month) * 100 + month(month) AS yyyymm, me, round(me / lag(me) OVER (PARTITION BY permno ORDER BY month) - 1, 8) AS ret FROM g),
chars AS (SELECT permno, CAST(year(month) * 100 + month(month) AS INTEGER) AS yyyymm, {', '.join(CHARACTERISTICS)} FROM g),
macro AS (
  SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS yyyymm, {', '.join(f'round({x}, 8) AS macro_{m}' for m, x in zip(MACRO_NAMES, _MONTHLY, strict=True))},
    round({_SHARE.format("o_orderstatus = 'F'")} / 100, 8) AS rf_welch_goyal, round({_SHARE.format("o_orderstatus = 'O'")} / 100, 8) AS rf_ff,
    {', '.join(f'round({_SHARE.format(_P.format(p))} - 0.2, 8) AS {c}' for c, p in _FACTORS.items())}, round(max(o_totalprice) / 1e6, 8) AS umd
  FROM orders GROUP BY 1
),
target AS (
  SELECT r.permno, r.month, r.yyyymm, me, ret, rf_welch_goyal, rf_ff, {', '.join(_FACTORS)}, umd, ret - rf_welch_goyal AS ret_excess,
    lead(ret - rf_welch_goyal) OVER w AS ret_excess_lead1, lead(r.month) OVER w AS next_month
  FROM returns r LEFT JOIN macro m ON r.yyyymm = m.yyyymm WINDOW w AS (PARTITION BY r.permno ORDER BY r.month)
),
allrows AS (
  SELECT t.permno, t.month, CAST(t.yyyymm AS INTEGER) AS yyyymm, coalesce(t.me, 0.0) AS market_equity, t.ret, t.rf_welch_goyal, t.rf_ff, {', '.join('t.' + c for c in _FACTORS)}, t.umd, t.ret_excess, t.ret_excess_lead1, t.next_month,
    {', '.join('c.' + c for c in CHARACTERISTICS)}, s.s_nationkey AS sic2, {', '.join(f'coalesce(m.{c}, 0.0) AS {c}' for c in MACROS)}
  FROM target t JOIN chars c ON t.permno = c.permno AND t.yyyymm = c.yyyymm LEFT JOIN supplier s ON s.s_suppkey = t.permno LEFT JOIN macro m ON m.yyyymm = t.yyyymm
  WHERE t.next_month = last_day(t.month + INTERVAL 1 MONTH) AND t.ret_excess_lead1 IS NOT NULL
),
panel AS (SELECT * FROM allrows WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CHARACTERISTICS)}),
split AS (
  SELECT *, CASE WHEN month <= DATE '1997-12-31' THEN 'train' WHEN month <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS split
  FROM panel WHERE month BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
),
forecasts AS (
  SELECT permno, month, ret_excess_lead1, market_equity, split, 'a' AS model, round((disc - 0.05) * 0.8, 8) AS forecast FROM split
  UNION ALL SELECT permno, month, ret_excess_lead1, market_equity, split, 'b', round((qty - 25) / 100, 8) FROM split
  UNION ALL SELECT permno, month, ret_excess_lead1, market_equity, split, 'c', round((tax - 0.04) * qty / 10, 8) FROM split
),
one AS (SELECT * EXCLUDE (model) FROM forecasts WHERE model = 'a'),
placed AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY forecast, permno) AS place, count(*) OVER (PARTITION BY month) AS n FROM one),
deciles AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, CAST(((place - 1) * 10 + n - 2) // (n - 1) AS INTEGER)) END AS bucket FROM placed),
portfolios AS (SELECT month, bucket, sum(ret_excess_lead1 * market_equity) / sum(market_equity) AS portfolio_return FROM deciles WHERE bucket IS NOT NULL GROUP BY 1, 2),
spread AS (SELECT month, max(portfolio_return) FILTER (bucket = 10) - max(portfolio_return) FILTER (bucket = 1) AS long_short FROM portfolios GROUP BY 1),
errors AS (SELECT permno, month, model, (ret_excess_lead1 - forecast) * (ret_excess_lead1 - forecast) AS e FROM forecasts),
pairs AS (SELECT a.model AS model_a, b.model AS model_b, a.month, avg(a.e - b.e) AS diff FROM errors a JOIN errors b ON a.permno = b.permno AND a.month = b.month AND a.model < b.model GROUP BY 1, 2, 3)
"""


def _q(body: str, more: str = "") -> str:
    return f"WITH {_RAW}{', ' + more if more else ''}\n{body}"


def _r(x: str, name: str | None = None) -> str:
    return f"round({x} + 3e-9, 6) + 0.0 AS {name or x}"


def _list(columns: list[str]) -> str:
    return ", ".join(map(_r, columns))


def _rank(c: str, by: str) -> str:
    w = f"PARTITION BY {by} ORDER BY {c} NULLS LAST"
    return f"(rank() OVER ({w}) + count({c}) OVER ({w} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"


def _pct(c: str, by: str = "month") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN -1 + 2 * {_rank(c, by)} / count({c}) OVER (PARTITION BY {by}) END"


def _minmax(c: str, by: str = "month") -> str:
    n = f"count({c}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {c} IS NOT NULL AND {n} > 1 THEN 2 * ({_rank(c, by)} - 1) / ({n} - 1) - 1 END"


_R2 = "1 - sum((ret_excess_lead1 - {0}) * (ret_excess_lead1 - {0})) / sum(ret_excess_lead1 * ret_excess_lead1)"
_MSE = "avg((ret_excess_lead1 - {0}) * (ret_excess_lead1 - {0}))"
_LINE = "line AS (SELECT model, regr_slope(ret_excess_lead1, forecast) AS slope, regr_intercept(ret_excess_lead1, forecast) AS intercept FROM forecasts WHERE split = 'validation' GROUP BY 1), adjusted AS (SELECT f.*, intercept + slope * forecast AS calibrated FROM forecasts f JOIN line USING (model))"
_SHARPE = "sqrt({1}) * avg({0}) / nullif(stddev_samp({0}), 0)"
_PAST = "(PARTITION BY permno ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PRODUCTS = {f"{c}__x__{m}": f"{c} * {m}" for c in CHARACTERISTICS for m in MACROS}
_FOLDS = "folds(fold, split, a, b) AS (VALUES {})"


def _folds(rows: list[tuple[int, str, int, int]]) -> str:
    return _FOLDS.format(", ".join(f"({k}, '{p}', {a}, {b})" for k, p, a, b in rows))


def _newey_west(source: str, by: str, lags: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    lagged = ", ".join(f"u * lag(u, {k}) OVER ({part}ORDER BY month) AS p{k}" for k in range(1, lags + 1))
    total = " + ".join(["sum(u * u)", *(f"2 * {1 - k / (lags + 1)!r} * coalesce(sum(p{k}), 0)" for k in range(1, lags + 1))])
    inner = f"c AS (SELECT {keys}month, diff, diff - avg(diff) OVER ({part}) AS u FROM {source}), p AS (SELECT {keys}diff, u, {lagged} FROM c), s AS (SELECT {keys}avg(diff) AS mean_diff, count(diff) AS n_months, {total} AS v FROM p{' GROUP BY ' + by if by else ''})"
    return _q(f"SELECT {keys}{_r('mean_diff')}, n_months, {_r('CASE WHEN v > 0 THEN sqrt(v / (n_months * n_months)) END', 'nw_se')}, {_r('CASE WHEN v > 0 THEN mean_diff / sqrt(v / (n_months * n_months)) END', 'dm_stat')} FROM s", inner)


def _two_features(alpha: float) -> str:
    """Cramer's rule on standardised features with alpha on the diagonal."""
    sums = f"s AS (SELECT count(*) AS n, avg(disc) AS m1, avg(qty) AS m2, avg(ret_excess_lead1) AS my, stddev_pop(disc) AS s1, stddev_pop(qty) AS s2, covar_pop(disc, qty) AS c12, covar_pop(disc, ret_excess_lead1) AS c1, covar_pop(qty, ret_excess_lead1) AS c2 FROM split WHERE split = 'train'), z AS (SELECT *, n + {alpha} AS d, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS y1, n * c2 / s2 AS y2 FROM s), b AS (SELECT *, (y1 * d - o * y2) / (d * d - o * o) / s1 AS b1, (y2 * d - o * y1) / (d * d - o * o) / s2 AS b2 FROM z)"
    return _q(f"SELECT permno, month, split, {_r('my + b1 * (disc - m1) + b2 * (qty - m2)', 'forecast')} FROM split, b WHERE split <> 'train'", sums)


def _industry_ridge(alphas: str) -> str:
    """Ridge on the products of characteristics and industry, for each alpha: f has all rows with their forecasts.

    The products of an industry meet no other, so that the scaled system is one of blocks less a product of the means; the blocks
    are eliminated row by row with two right-hand sides.
    """
    k = len(CHARACTERISTICS)
    steps = []
    for i in range(1, k + 1):
        row = f"list_transform(range(1, {k + 3}), lambda j: m[a][j] - m[a][{i}] / m[{i}][{i}] * m[{i}][j])"
        own = f"list_transform(range(1, {k + 3}), lambda j: m[{i}][j] / m[{i}][{i}])"
        steps.append(f"e{i} AS (SELECT alpha, sic2, list_transform(range(1, {k + 1}), lambda a: CASE WHEN a = {i} THEN {own} ELSE {row} END) AS m FROM e{i - 1})")
    return f"""
x AS (SELECT permno, month, split, sic2, ret_excess_lead1 AS y, [{', '.join(CHARACTERISTICS)}] AS x FROM split),
t AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my FROM x WHERE split = 'train'),
c AS (SELECT sic2, i, j, sum(x[i] * x[j]) AS g, sum(x[i]) AS sx, sum(x[i] * x[i]) AS sxx, sum(x[i] * y) AS sxy FROM x, range(1, {k + 1}) a(i), range(1, {k + 1}) b(j) WHERE split = 'train' GROUP BY ALL),
s AS (SELECT DISTINCT sic2, i, sx / n AS m, CASE WHEN sxx / n - (sx / n) ** 2 > 1e-14 * greatest(1, (sx / n) ** 2) THEN sqrt(sxx / n - (sx / n) ** 2) ELSE 1 END AS s, sxy - sx * my AS cy FROM c, t),
alphas(grid_index, alpha) AS (VALUES {alphas}),
r AS (
  SELECT alpha, c.sic2, c.i, list(c.g / (p.s * q.s) + CASE WHEN c.i = c.j THEN alpha ELSE 0 END ORDER BY c.j) || [any_value(p.cy / p.s), any_value(p.m / p.s)] AS m
  FROM alphas, c JOIN s p ON p.sic2 = c.sic2 AND p.i = c.i JOIN s q ON q.sic2 = c.sic2 AND q.i = c.j GROUP BY ALL
),
e0 AS (SELECT alpha, sic2, list(m ORDER BY i) AS m FROM r GROUP BY ALL), {', '.join(steps)},
u AS (SELECT alpha, s.sic2, s.i, s.m, s.s, e{k}.m[s.i][{k + 1}] AS u, e{k}.m[s.i][{k + 2}] AS w FROM e{k} JOIN s ON s.sic2 = e{k}.sic2),
v AS (SELECT alpha, sum(m / s * u) * any_value(n) / (1 - any_value(n) * sum(m / s * w)) AS v FROM u, t GROUP BY alpha),
b AS (SELECT u.alpha, sic2, i, m, (u + w * v) / s AS b FROM u JOIN v ON v.alpha = u.alpha),
z AS (SELECT alpha, any_value(my) - sum(b * m) AS a FROM b, t GROUP BY alpha),
bl AS (SELECT alpha, sic2, list(b ORDER BY i) AS b FROM b GROUP BY ALL),
f AS (
  SELECT permno, month, split, y, grid_index, z.alpha, z.a + coalesce(list_sum(list_transform(range(1, {k + 1}), lambda i: bl.b[i] * x.x[i])), 0) AS forecast
  FROM x CROSS JOIN alphas JOIN z ON z.alpha = alphas.alpha LEFT JOIN bl ON bl.alpha = z.alpha AND bl.sic2 = x.sic2
)"""


def _walk_forward(alphas: str, expanding: bool) -> str:
    """Ridge (alpha 0: least squares) on two features for each fold: w has every fold's validation R2 and coefficients by alpha, best the chosen ones."""
    folds = _folds([(k, p, 1995 + (0 if expanding and p == "train" else k) + a, 1995 + k + b) for k in range(4) for p, a, b in (("train", 0, 1), ("validation", 2, 2), ("test", 3, 3))])
    return f"""{folds},
o AS (SELECT fold, f.split AS part, p.* FROM panel p JOIN folds f ON year(month) BETWEEN a AND b),
s AS (
  SELECT fold, count(*) AS n, avg(disc) AS m1, avg(qty) AS m2, avg(ret_excess_lead1) AS my, stddev_pop(disc) AS s1, stddev_pop(qty) AS s2,
    covar_pop(disc, qty) AS c12, covar_pop(disc, ret_excess_lead1) AS c1, covar_pop(qty, ret_excess_lead1) AS c2
  FROM o WHERE part = 'train' GROUP BY fold
),
alphas(grid_index, alpha) AS (VALUES {alphas}),
z AS (SELECT *, n + alpha AS d, n * c12 / (s1 * s2) AS r, n * c1 / s1 AS y1, n * c2 / s2 AS y2 FROM s, alphas),
k AS (SELECT *, (y1 * d - r * y2) / (d * d - r * r) / s1 AS b1, (y2 * d - r * y1) / (d * d - r * r) / s2 AS b2 FROM z),
scores AS (SELECT o.fold, grid_index, 1 - sum((ret_excess_lead1 - my - b1 * (disc - m1) - b2 * (qty - m2)) ** 2) / sum(ret_excess_lead1 * ret_excess_lead1) AS r2 FROM o JOIN k ON k.fold = o.fold WHERE part = 'validation' GROUP BY ALL),
best AS (SELECT k.*, r2 FROM k JOIN scores ON scores.fold = k.fold AND scores.grid_index = k.grid_index QUALIFY row_number() OVER (PARTITION BY k.fold ORDER BY r2 DESC, k.grid_index) = 1),
w AS (SELECT permno, month, best.fold, alpha::DOUBLE AS alpha, my + b1 * (disc - m1) + b2 * (qty - m2) AS forecast FROM o JOIN best ON best.fold = o.fold WHERE part = 'test')"""


def _tree(depth: int = 2, leaf: int = 100) -> str:
    """The regression tree on n_lines, every cut tried: f has all rows with the mean of their leaf."""
    steps = []
    for k in range(depth):
        steps.append(f"""
v{k} AS (SELECT node, x, count(*) AS n, sum(y) AS s FROM t{k} WHERE split = 'train' GROUP BY ALL),
u{k} AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY node) AS tn, sum(s) OVER (PARTITION BY node) AS ts, lead(x) OVER w AS above FROM v{k} WINDOW w AS (PARTITION BY node ORDER BY x)),
g{k} AS (SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM u{k} WHERE ln >= {leaf} AND tn - ln >= {leaf}),
c{k} AS (SELECT node, (x + above) / 2 AS cut FROM g{k} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, x) = 1),
t{k + 1} AS (SELECT t{k}.* REPLACE (2 * node + CASE WHEN x > cut THEN 1 ELSE 0 END AS node) FROM t{k} LEFT JOIN c{k} USING (node))""")
    return f"""t0 AS (SELECT permno, month, split, n_lines AS x, ret_excess_lead1 AS y, 1 AS node FROM split),{','.join(steps)},
leaves AS (SELECT node, avg(y) AS forecast FROM t{depth} WHERE split = 'train' GROUP BY node),
f AS (SELECT t{depth}.*, forecast FROM t{depth} JOIN leaves USING (node))"""


def _pls(k: int) -> str:
    """Partial least squares from the products of standardised features: a step a component, each a row of lists."""
    c, p = CHARACTERISTICS, len(CHARACTERISTICS)
    gram = ", ".join("[" + ", ".join(f"n * covar_pop({a}, {b}) / (stddev_samp({a}) * stddev_samp({b}))" for b in c) + "]" for a in c)
    first = (
        f"s0 AS (SELECT avg(ret_excess_lead1) AS my, [{', '.join(f'avg({a})' for a in c)}] AS m, [{', '.join(f'stddev_samp({a})' for a in c)}] AS sd, [{gram}] AS xx, "
        f"[{', '.join(f'n * covar_pop({a}, ret_excess_lead1) / stddev_samp({a})' for a in c)}] AS xy FROM split, (SELECT count(*) AS n FROM split WHERE split = 'train') WHERE split = 'train' GROUP BY n), "
        "k0 AS (SELECT *, xy AS s, []::DOUBLE[][] AS w, []::DOUBLE[][] AS p, []::DOUBLE[] AS q FROM s0)"
    )
    steps = []
    for i in range(k):
        r = f"a{i} AS (SELECT *, list_transform(s, lambda v: v / sqrt(list_dot_product(s, s))) AS r0 FROM k{i})"
        cleaned = "r0" if i == 0 else "list_transform(range(1, {0}), lambda j: r0[j] - w[1][j] * list_dot_product(p[1], r0))".format(p + 1)
        steps += [
            r,
            f"b{i} AS (SELECT *, {cleaned} AS r FROM a{i})",
            f"d{i} AS (SELECT *, list_transform(xx, lambda row: list_dot_product(row, r)) AS xr FROM b{i})",
            f"e{i} AS (SELECT *, list_dot_product(r, xr) AS t FROM d{i})",
            f"k{i + 1} AS (SELECT my, m, sd, xx, xy, list_transform(range(1, {p + 1}), lambda j: s[j] - xr[j] / t * list_dot_product(r, xy)) AS s, list_append(w, r) AS w, list_append(p, list_transform(xr, lambda v: v / t)) AS p, "
            f"list_append(q, list_dot_product(r, xy) / t) AS q FROM e{i})",
        ]
    beta = f"list_transform(range(1, {p + 1}), lambda j: ({' + '.join(f'w[{i + 1}][j] * q[{i + 1}]' for i in range(k))}) / sd[j])"
    return ", ".join([first, *steps, f"z AS (SELECT my, m, {beta} AS b FROM k{k})"])


def _spline_1f(knot: float, penalty: float) -> str:
    """Group lasso on qty and one square: in the basis (1, 1), (1, -1) the length of the coefficients is the root of one equation, found by halving."""
    return f"""
x AS (SELECT permno, month, split, ret_excess_lead1 AS y, qty AS a, (qty - {knot}) * (qty - {knot}) AS b FROM split),
s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb, {penalty} * sqrt(2) AS l FROM x WHERE split = 'train'),
turned AS (SELECT *, (ca + cb) / sqrt(2) AS c1, (ca - cb) / sqrt(2) AS c2 FROM s),
h AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 1e6::DOUBLE AS high FROM turned
  UNION ALL
  SELECT k + 1, CASE WHEN big THEN mid ELSE low END, CASE WHEN big THEN high ELSE mid END
  FROM (SELECT h.*, (low + high) / 2 AS mid, (c1 / ((1 + r) * (low + high) / 2 + l)) ** 2 + (c2 / ((1 - r) * (low + high) / 2 + l)) ** 2 > 1 AS big FROM h, turned WHERE k < 200)
),
t AS (SELECT turned.*, CASE WHEN c1 * c1 + c2 * c2 <= l * l THEN 0 ELSE low END AS t FROM turned, h WHERE k = 200),
v AS (SELECT *, CASE WHEN t > 0 THEN c1 / (1 + r + l / t) ELSE 0 END AS d1, CASE WHEN t > 0 THEN c2 / (1 - r + l / t) ELSE 0 END AS d2 FROM t)"""


def _linear_step(rate: float = 0.05, l2: float = 1e-4) -> str:
    """One step of Adam from the first weights of a network without hidden layers: each weight moves by rate g / (|g| + 1e-8)."""
    from panelkiln.operators.neural import _start

    w1, w2 = (float(v) for v in _start([], 2, 1)[0][:, 0])
    moved = ", ".join(f"{w!r} - {rate} * {g} / (abs({g}) + 1e-8) AS {n}" for w, g, n in ((w1, "g1", "w1"), (w2, "g2", "w2"), (0.0, "g0", "w0")))
    return f"""
s AS (SELECT avg(disc) AS m1, avg(qty) AS m2, stddev_pop(disc) AS s1, stddev_pop(qty) AS s2 FROM split WHERE split = 'train'),
z AS (SELECT permno, month, split, ret_excess_lead1 AS y, (disc - m1) / s1 AS z1, (qty - m2) / s2 AS z2 FROM split, s),
e AS (SELECT *, {w1!r} * z1 + {w2!r} * z2 - y AS e FROM z WHERE split = 'train'),
d AS (SELECT 2 * avg(e * z1) + {l2} * {w1!r} AS g1, 2 * avg(e * z2) + {l2} * {w2!r} AS g2, 2 * avg(e) AS g0 FROM e),
w AS (SELECT {moved} FROM d)"""


def _three_features() -> str:
    x = ("disc", "qty", "tax")
    cov = ", ".join([*(f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x) if i <= j), *(f"covar_pop({a}, ret_excess_lead1) AS y{i}, avg({a}) AS m{i}" for i, a in enumerate(x))])
    det = "c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02)"
    d0 = "y0 * (c11 * c22 - c12 * c12) - c01 * (y1 * c22 - c12 * y2) + c02 * (y1 * c12 - c11 * y2)"
    d1 = "c00 * (y1 * c22 - c12 * y2) - y0 * (c01 * c22 - c12 * c02) + c02 * (c01 * y2 - y1 * c02)"
    d2 = "c00 * (c11 * y2 - y1 * c12) - c01 * (c01 * y2 - y1 * c02) + y0 * (c01 * c12 - c11 * c02)"
    more = f"s AS (SELECT avg(ret_excess_lead1) AS my, {cov} FROM split WHERE split = 'train'), b AS (SELECT *, ({d0}) / ({det}) AS b0, ({d1}) / ({det}) AS b1, ({d2}) / ({det}) AS b2 FROM s)"
    return _q(f"SELECT permno, month, split, {_r('my + b0 * (disc - m0) + b1 * (qty - m1) + b2 * (tax - m2)', 'forecast')} FROM split, b WHERE split <> 'train'", more)


def _importance(terms: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{k}' AS feature, {t} AS t, ret_excess_lead1, f FROM m" for k, t in terms.items())
    more = f"m AS (SELECT *, -0.2 + 0.8 * disc + 0.01 * qty - 0.5 * tax AS f FROM panel), long AS ({rows}), r AS (SELECT feature, 1 - sum((ret_excess_lead1 - f) * (ret_excess_lead1 - f)) / sum(ret_excess_lead1 * ret_excess_lead1) AS baseline_r2, 1 - sum((ret_excess_lead1 - f + t) * (ret_excess_lead1 - f + t)) / sum(ret_excess_lead1 * ret_excess_lead1) AS ablated_r2 FROM long GROUP BY 1)"
    return _q(f"SELECT feature, {_list(['baseline_r2', 'ablated_r2'])}, {_r('baseline_r2 - ablated_r2', 'importance')} FROM r", more)


def _moment(c: str, k: str) -> str:
    return f"(SELECT {k}({c}) FROM panel WHERE month <= DATE '1997-12-31')"


def _flagship() -> str:
    more = (
        f"ranked AS (SELECT permno, month, split, ret_excess_lead1, market_equity, {_pct('disc')} AS x1, {_pct('qty')} AS x2 FROM split), "
        "s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(ret_excess_lead1) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, ret_excess_lead1) AS y1, covar_pop(x2, ret_excess_lead1) AS y2 FROM ranked WHERE split = 'train'), "
        "p AS (SELECT permno, month, ret_excess_lead1, market_equity, my + (y1 * v2 - c * y2) / (v1 * v2 - c * c) * (x1 - m1) + (y2 * v1 - c * y1) / (v1 * v2 - c * c) * (x2 - m2) AS f FROM ranked, s WHERE split = 'test'), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY f, permno) AS place, count(*) OVER (PARTITION BY month) AS n FROM p), "
        "k AS (SELECT *, greatest(1, CAST(((place - 1) * 10 + n - 2) // nullif(n - 1, 0) AS INTEGER)) AS bucket FROM o WHERE n > 1)"
    )
    return _q(f"SELECT month, bucket, {_r('sum(ret_excess_lead1 * market_equity) / sum(market_equity)', 'portfolio_return')} FROM k GROUP BY 1, 2", more)


_PANEL_DOUBLES = ["market_equity", "ret", "rf_welch_goyal", "rf_ff", *_FACTORS, "umd", "ret_excess", "ret_excess_lead1", *CHARACTERISTICS, *MACROS]
_INDUSTRY = " UNION ALL ".join(f"SELECT permno, month, '{c}__x__sic2_' || sic2 AS feature, {c} AS value FROM panel" for c in CHARACTERISTICS)
_RIDGE_GRID = "grid(grid_index, alpha) AS (VALUES (0, 0.01), (1, 0.1), (2, 1.0), (3, 10.0), (4, 100.0), (5, 1000.0), (6, 10000.0), (7, 100000.0)), s AS (SELECT count(*) AS n, avg(disc) AS m, avg(ret_excess_lead1) AS my, stddev_pop(disc) AS sd, covar_pop(disc, ret_excess_lead1) AS c FROM split WHERE split = 'train'), f AS (SELECT grid_index, alpha, ret_excess_lead1, my + (n * c / sd) / (n + alpha) * (disc - m) / sd AS fc FROM split, s, grid WHERE split = 'validation')"
_ALPHAS = ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate((0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)))
_STACKED = "s AS (SELECT count(*) AS n, avg(disc) AS m, avg(ret_excess_lead1) AS my, stddev_pop(disc) AS sd, covar_pop(disc, ret_excess_lead1) AS c FROM split WHERE split = 'train'), k(model, alpha) AS (VALUES ('ols', 0.0), ('ridge', 10.0))"
_QUANTILES = ", ".join(f"{_r(f'quantile_cont(x, {s})', f'p{round(100 * s)}')}" for s in (0.01, 0.25, 0.5, 0.75, 0.99))
_LAGGED = "q AS (SELECT permno, last_day(month + INTERVAL 4 MONTH) AS at, ret AS v FROM returns WHERE month(month) % 3 = 0), y AS (SELECT permno, last_day(month + INTERVAL 6 MONTH) AS at, ret AS v FROM returns WHERE month(month) = 12), q1 AS (SELECT r.permno, r.month, q.v AS q_ret FROM returns r ASOF LEFT JOIN (SELECT * FROM q) q ON r.permno = q.permno AND r.month >= q.at)"
_REGRESSION = "rows AS (SELECT permno, month, regr_slope(ret_excess_lead1, disc) OVER w AS b, regr_intercept(ret_excess_lead1, disc) OVER w AS a, avg(ret_excess_lead1) OVER w AS hist_mean, count(*) OVER w AS n, disc FROM panel WINDOW w AS " + _PAST + ")"

ORACLES: dict[str, str] = {
    "panel_build": _q(f"SELECT permno, month, yyyymm, next_month, sic2, {_list(_PANEL_DOUBLES)} FROM panel"),
    "panel_manifest": _q(
        f"SELECT count(*) AS rows, {5 + len(_PANEL_DOUBLES)}::BIGINT AS columns, '{','.join(CHARACTERISTICS)}' AS characteristics, '' AS dummies, '{','.join(MACROS)}' AS macros, "
        "'ret_excess_lead1' AS target_column, 'month' AS date_column, 'permno' AS asset_column, 'market_equity' AS weight_column FROM panel"
    ),
    "sample_summary": _q(f"SELECT (SELECT count(*) FROM panel) AS n_rows, (SELECT count(DISTINCT permno) FROM panel) AS n_assets, (SELECT min(month) FROM panel) AS first_month, (SELECT max(month) FROM panel) AS last_month, {_r('avg(n)', 'mean_assets')}, {_r('avg(k)', 'mean_industries')}, count(*) AS n_months FROM (SELECT month, count(*) AS n, count(DISTINCT sic2) AS k FROM panel GROUP BY 1)"),
    "missing_rates": _q(" UNION ALL ".join(f"SELECT '{c}' AS feature, '{'trade' if c in ('n_lines', 'qty', 'disp') else 'terms'}' AS family, {_r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM chars" for c in CHARACTERISTICS)),
    "target_distribution": _q(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(x) AS n, {_r('avg(x)', 'mean')}, {_r('stddev_samp(x)', 'sd')}, {_QUANTILES} FROM (SELECT {c} AS x FROM panel)" for c in ("ret_excess_lead1", "market_equity"))),
    "rank_pct_scaled": _q(f"SELECT permno, month, {', '.join(_r(_pct(c), c) for c in CHARACTERISTICS)} FROM panel"),
    "rank_minmax_scaled": _q(f"SELECT permno, month, {', '.join(_r(_minmax(c), c) for c in CHARACTERISTICS)} FROM panel"),
    "ranked_characteristics": _q(f"SELECT permno, yyyymm, {', '.join(_r(_minmax(c, 'yyyymm'), c) for c in CHARACTERISTICS)} FROM chars"),
    "rank_guard": _q("SELECT 'raw' AS table_state, " + " OR ".join(f"min({c}) < -1 OR max({c}) > 1" for c in CHARACTERISTICS) + " AS raw_values FROM chars UNION ALL SELECT 'ranked', " + " OR ".join(f"coalesce(min({c}) < -1 OR max({c}) > 1, false)" for c in CHARACTERISTICS) + " FROM k", f"k AS (SELECT {', '.join(f'{_minmax(c, 'yyyymm')} AS {c}' for c in CHARACTERISTICS)} FROM chars)"),
    "per_date_counts": _q(f"SELECT yyyymm, {', '.join(f'count({c}) AS {c}' for c in CHARACTERISTICS)} FROM chars GROUP BY 1"),
    "median_impute": _q(f"SELECT permno, month, {', '.join(_r(f'coalesce({c}, median({c}) OVER (PARTITION BY month))', c) for c in CHARACTERISTICS)} FROM allrows"),
    "asof_release_lag": _q(f"SELECT q1.permno, q1.month, {_r('q_ret', 'q_ret_lag4')}, {_r('y.v', 'a_ret_lag6')} FROM q1 ASOF LEFT JOIN y ON q1.permno = y.permno AND q1.month >= y.at", _LAGGED),
    "macro_interactions": _q(f"SELECT permno, month, {', '.join(_r(x, n) for n, x in _PRODUCTS.items())} FROM panel"),
    "kronecker_features": _q(f"SELECT permno, month, {_list(CHARACTERISTICS)}, {', '.join(_r(f'{c} * {m}', f'{c}__x__{m}') for c in CHARACTERISTICS for m in MACROS)}, {', '.join(f'CASE WHEN sic2 = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS sic2_{k}' for k in range(25))} FROM panel"),
    "industry_interactions_long": _q(f"SELECT permno, month, feature, {_r('value')} FROM ({_INDUSTRY}) WHERE value <> 0"),
    "interaction_vector": _q(f"SELECT permno, month, CAST({' + '.join(f'CASE WHEN {c} <> 0 THEN 1 ELSE 0 END' for c in CHARACTERISTICS)} AS BIGINT) AS n_nonzero, {_r(' + '.join(CHARACTERISTICS), 'total')} FROM panel"),
    "spline_basis": _q(f"SELECT permno, month, {_r('qty')}, {', '.join(_r(f'(qty - {k}) * (qty - {k})', f'qty_sq{i}') for i, k in enumerate((20.0, 25.0, 30.0)))} FROM panel"),
    "standardized_features": _q(f"SELECT permno, month, {', '.join(_r(f'({c} - {_moment(c, 'avg')}) / nullif({_moment(c, 'stddev_pop')}, 0)', c) for c in CHARACTERISTICS)} FROM panel"),
    "scaled_features": _q(f"SELECT permno, month, {', '.join(_r(f'{c} / {_moment(c, 'stddev_pop')}', c) for c in CHARACTERISTICS)} FROM panel"),
    "market_equity_sic2": f"SELECT l_orderkey, l_linenumber, {_r('l_extendedprice * l_quantity', 'me')}, CAST(l_partkey // 100 AS INTEGER) AS sic2 FROM lineitem",
    "fixed_split_counts": _q("SELECT split, count(*) AS n_rows FROM split GROUP BY 1"),
    "rolling_split_counts": _q("SELECT fold, f.split, count(*) AS n_rows FROM panel JOIN folds f ON year(month) BETWEEN a AND b GROUP BY 1, 2", _folds([(k, p, 1995 + k + a, 1995 + k + b) for k in range(2) for p, a, b in (("train", 0, 2), ("validation", 3, 4), ("test", 5, 5))])),
    "expanding_split_counts": _q("SELECT fold, f.split, count(*) AS n_rows FROM panel JOIN folds f ON year(month) BETWEEN a AND b GROUP BY 1, 2", _folds([(k, p, 1995 + (0 if p == "train" else k) + a, 1995 + k + b) for k in range(3) for p, a, b in (("train", 0, 2), ("validation", 3, 3), ("test", 4, 4))])),
    "oos_r2_by_model": _q(f"SELECT model, split, count(*) AS n_rows, {_r(_R2.format('forecast'), 'r2')} FROM forecasts GROUP BY 1, 2"),
    "mse_mae": _q(f"SELECT model, {_r(_MSE.format('forecast'), 'mse')}, {_r('avg(abs(ret_excess_lead1 - forecast))', 'mae')} FROM forecasts GROUP BY 1"),
    "monthly_ic": _q(f"SELECT model, {_r('avg(ic)', 'mean_ic')}, count(ic) AS n_months FROM (SELECT model, month, corr(ret_excess_lead1, forecast) AS ic FROM forecasts GROUP BY 1, 2) GROUP BY 1"),
    "calibration": _q(f"SELECT model, {_list(['slope', 'intercept'])} FROM line", _LINE),
    "calibrated_evaluation": _q(f"SELECT model, {_r(_R2.format('calibrated'), 'r2')}, {_r(_MSE.format('calibrated'), 'mse')} FROM adjusted WHERE split = 'test' GROUP BY 1", _LINE),
    "full_evaluation": _q(f"SELECT model, {', '.join(_r(x.format(c), f'{n}_{k}') for k, c in (('raw', 'forecast'), ('calibrated', 'calibrated')) for n, x in (('r2', _R2), ('mse', _MSE), ('mae', 'avg(abs(ret_excess_lead1 - {0}))')))}, any_value(mean_ic) AS mean_ic, any_value(n_months) AS n_months FROM adjusted JOIN ic USING (model) WHERE split = 'test' GROUP BY 1", _LINE + f", ic AS (SELECT model, {_r('avg(ic)', 'mean_ic')}, count(ic) AS n_months FROM (SELECT model, month, corr(ret_excess_lead1, forecast) AS ic FROM forecasts WHERE split = 'test' GROUP BY 1, 2) GROUP BY 1)"),
    "model_metrics": _q("SELECT model, max(n) FILTER (split = 'test') AS test_rows, max(r2) FILTER (split = 'test') AS test_oos_r2, max(r2) FILTER (split = 'validation') AS validation_oos_r2 FROM b GROUP BY 1", f"b AS (SELECT model, split, count(*) AS n, {_r(_R2.format('forecast'), 'r2')} FROM forecasts GROUP BY 1, 2)"),
    "stacked_predictions": _q(f"SELECT month, permno, {_r('ret_excess_lead1')}, {_r('my + (n * c / sd) / (n + alpha) * (disc - m) / sd', 'forecast')}, model, split FROM split, s, k WHERE split <> 'train'", _STACKED),
    "dm_pooled": _q(f"SELECT count(x) AS n, {_r('avg(x)', 'mean_diff')}, {_r('avg(x) / (stddev_samp(x) / sqrt(count(x)))', 'dm_stat')} FROM (SELECT a.e - b.e AS x FROM errors a JOIN errors b ON a.permno = b.permno AND a.month = b.month AND a.model = 'a' AND b.model = 'b')"),
    "monthly_error_difference": _q(f"SELECT model_a, model_b, month, {_r('diff')} FROM pairs"),
    "dm_newey_west": _newey_west("(SELECT * FROM pairs WHERE model_a = 'a' AND model_b = 'b')", "", 12),
    "dm_matrix": _newey_west("pairs", "model_a, model_b", 3),
    "forecast_deciles": _q(f"SELECT permno, month, {_r('forecast')}, bucket FROM deciles"),
    "vw_returns": _q(f"SELECT month, bucket, {_r('portfolio_return')} FROM portfolios"),
    "long_short": _q(f"SELECT month, {_r('long_short')} FROM spread"),
    "decile_performance": _q(f"SELECT bucket, {_r('avg(portfolio_return)', 'mean_return')}, {_r('stddev_samp(portfolio_return) * sqrt(12)', 'volatility')}, {_r(_SHARPE.format('portfolio_return', 12), 'sharpe')} FROM portfolios GROUP BY 1"),
    "decile_monotonicity": _q(f"SELECT {_r('avg(CASE WHEN rise THEN 1.0 WHEN NOT rise THEN 0.0 END)', 'share_rising')}, {_r('corr(bucket, m)', 'bucket_corr')} FROM (SELECT bucket, m, m > lag(m) OVER (ORDER BY bucket) AS rise FROM (SELECT bucket, avg(portfolio_return) AS m FROM portfolios GROUP BY 1))"),
    "turnover": _q(
        f"SELECT month, bucket, {_r('sum(abs(coalesce(w, 0) - coalesce(v, 0))) / 2', 'turnover')} FROM u WHERE (month, bucket) IN (SELECT month, bucket FROM h) AND (month, bucket) IN (SELECT month, bucket FROM p) GROUP BY 1, 2",
        "h AS (SELECT permno, month, bucket, market_equity / sum(market_equity) OVER (PARTITION BY month, bucket) AS w FROM deciles WHERE bucket IS NOT NULL), p AS (SELECT permno, last_day(month + INTERVAL 1 MONTH) AS month, bucket, w AS v FROM h), u AS (SELECT * FROM h FULL JOIN p USING (permno, month, bucket))",
    ),
    "sharpe": _q(f"SELECT {_r(_SHARPE.format('long_short', 12), 'sharpe')} FROM spread"),
    "r2_to_sharpe": _q(f"SELECT {_list(['r2', 'sr'])}, {_r('sqrt((sr * sr + greatest(r2, 0.001)) / (1 - greatest(r2, 0.001)))', 'reachable')} FROM (SELECT {_R2.format('forecast')} AS r2, {_SHARPE.format('ret_excess_lead1', 1)} AS sr FROM one)"),
    "timing_strategy": _q(f"SELECT {_r(_SHARPE.format('(p * r)', 12), 'timed')}, {_r(_SHARPE.format('r', 12), 'held')}, {_r('avg(p)', 'mean_position')} FROM (SELECT least(greatest(50.0 * avg(forecast), 0), 1.5) AS p, avg(ret_excess_lead1) AS r FROM one GROUP BY month)"),
    "positive_forecasts": _q(f"SELECT permno, month, {_r('greatest(0.0, forecast)', 'forecast')} FROM one"),
    "hist_mean_benchmark": _q(f"SELECT permno, month, {_r('avg(ret_excess) OVER (PARTITION BY permno ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'hist_mean')} FROM panel"),
    "sign_restricted_forecast": _q(f"SELECT permno, month, {_r('hist_mean')}, {_r('CASE WHEN n >= 12 AND b > 0 THEN a + b * disc ELSE hist_mean END', 'restricted')} FROM rows", _REGRESSION),
    "drop_importance_linear": _importance({"disc": "0.8 * disc", "qty": "0.01 * qty", "tax": "-0.5 * tax"}),
    "group_importance": _importance({"terms": "0.8 * disc - 0.5 * tax", "trade": "0.01 * qty"}),
    "ssd_importance": _q(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'{b!r}::DOUBLE * {b!r}::DOUBLE * count(*)', 'ssd')} FROM panel" for c, b in (("disc", 0.8), ("qty", 0.01), ("tax", -0.5)))),
    "top_bottom_subsample": _q("SELECT permno, month, CASE WHEN d <= 3 THEN 'top' ELSE 'bottom' END AS side FROM (SELECT permno, month, row_number() OVER (PARTITION BY month ORDER BY market_equity DESC, permno) AS d, row_number() OVER (PARTITION BY month ORDER BY market_equity, permno) AS u FROM panel) WHERE d <= 3 OR u <= 3"),
    "regime_subsample": _q("SELECT CASE WHEN macro_svar > (SELECT median(x) FROM m) THEN 'high' ELSE 'low' END AS regime, count(*) AS n_rows, count(DISTINCT month) AS n_months FROM panel GROUP BY 1", "m AS (SELECT month, max(macro_svar) AS x FROM panel GROUP BY 1)"),
    "period_sector_subsample": _q("SELECT CASE WHEN year(month) < 2000 THEN 'pre' ELSE 'post' END AS period, CASE WHEN sic2 + 50 BETWEEN 60 AND 67 THEN 'financial' ELSE 'other' END AS sector, count(*) AS n_rows FROM panel GROUP BY 1, 2"),
    "panel_head": _q(f"SELECT permno, month, {_list(CHARACTERISTICS)} FROM (SELECT * FROM panel ORDER BY month, permno LIMIT 50)"),
    "duplicate_keys": "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "loss_table": _q(f"SELECT model, {_r('avg(u * u)', 'mse')}, {_r('avg(CASE WHEN abs(u) <= 0.5 THEN u * u ELSE abs(u) - 0.25 END)', 'huber')}, {_r('sum(market_equity * u * u) / count(*) / avg(market_equity)', 'weighted')} FROM (SELECT *, ret_excess_lead1 - forecast AS u FROM forecasts) GROUP BY 1"),
    "ols_forecast_2f": _two_features(0.0),
    "ridge_forecast_2f": _two_features(100.0),
    "wls_forecast_1f": _q(f"SELECT permno, month, split, {_r('my + b * (disc - mx)', 'forecast')} FROM split, t WHERE split <> 'train'", "s AS (SELECT sum(market_equity * disc) / sum(market_equity) AS mx, sum(market_equity * ret_excess_lead1) / sum(market_equity) AS my FROM split WHERE split = 'train'), t AS (SELECT any_value(mx) AS mx, any_value(my) AS my, sum(market_equity * (disc - mx) * (ret_excess_lead1 - my)) / sum(market_equity * (disc - mx) * (disc - mx)) AS b FROM split, s WHERE split = 'train')"),
    "ridge_grid_1f": _q(f"SELECT grid_index, alpha::DOUBLE AS alpha, {_r(_R2.format('fc'), 'validation_r2')} FROM f GROUP BY 1, 2", _RIDGE_GRID),
    **{n: _q(f"SELECT permno, month, split, {_r('forecast')} FROM f WHERE split <> 'train'", _industry_ridge("(0, 10.0)")) for n in ("ridge_sparse_forecast", "ridge_sparse_conjugate")},
    "ridge_sparse_grid": _q(f"SELECT grid_index, alpha::DOUBLE AS alpha, {_r('1 - sum((y - forecast) ** 2) / sum(y * y)', 'validation_r2')} FROM f WHERE split = 'validation' GROUP BY ALL", _industry_ridge(_ALPHAS)),
    "walk_forward_ols": _q(f"SELECT permno, month, fold, {_r('forecast')} FROM w", _walk_forward("(0, 0.0)", False)),
    "walk_forward_ridge": _q(f"SELECT permno, month, fold, alpha, {_r('forecast')} FROM w", _walk_forward(_ALPHAS, True)),
    "walk_forward_choices": _q(f"SELECT fold, alpha::DOUBLE AS alpha, {_r('r2', 'validation_r2')}, n AS train_rows FROM best", _walk_forward(_ALPHAS, True)),
    "ols3_forecast": _three_features(),
    "decile_table": _flagship(),
}
_PCR = """s AS (
  SELECT count(*) AS n, avg(ret_excess_lead1) AS my, avg(disc) AS m1, avg(qty) AS m2, stddev_pop(disc) AS s1, stddev_pop(qty) AS s2, avg(disc * disc) AS q1, avg(qty * qty) AS q2, avg(disc * qty) AS q12,
    covar_pop(disc, qty) AS c12, covar_pop(disc, ret_excess_lead1) AS y1, covar_pop(qty, ret_excess_lead1) AS y2
  FROM split WHERE split = 'train'
),
a AS (SELECT *, atan2(2 * q12 / (s1 * s2), q1 / (s1 * s1) - q2 / (s2 * s2)) / 2 AS angle FROM s),
b AS (SELECT *, cos(angle) / s1 AS v1, sin(angle) / s2 AS v2 FROM a),
k AS (SELECT *, n * (v1 * y1 + v2 * y2) / (n * (v1 * v1 * s1 * s1 + 2 * v1 * v2 * c12 + v2 * v2 * s2 * s2) + 1) AS gamma FROM b)"""
_ENET = """s AS (SELECT avg(ret_excess_lead1) AS my, avg(disc) AS m, stddev_pop(disc) AS sd, covar_pop(disc, ret_excess_lead1) / stddev_pop(disc) AS c FROM split WHERE split = 'train'),
b AS (SELECT *, sign(c) * greatest(abs(c) - 0.01, 0) / 1.01 / sd AS b FROM s)"""
_DROPS = "SELECT feature, {}, {}, {} FROM (SELECT r.feature AS feature, 1 - sum((y - f) * (y - f)) / sum(y * y) AS base, 1 - sum((y - r.g) * (y - r.g)) / sum(y * y) AS r2 FROM a GROUP BY 1)"
_LOWER_MEDIAN = "SELECT y AS start FROM (SELECT y, row_number() OVER (ORDER BY y) AS k, count(*) OVER () AS n FROM t0 WHERE split = 'train') WHERE k = (n + 1) // 2"
_FORECAST = f"SELECT permno, month, split, {_r('forecast')} FROM f WHERE split <> 'train'"
_ROWS = "SELECT permno, month, split, {} FROM {} WHERE split <> 'train'"
ORACLES |= {
    "pcr_2f": _q(_ROWS.format(_r("my + gamma * (v1 * (disc - m1) + v2 * (qty - m2))", "forecast"), "split, k"), _PCR),
    "pls": _q(_ROWS.format(_r(f"my + list_dot_product(b, [{', '.join(CHARACTERISTICS)}]) - list_dot_product(b, m)", "forecast"), "split, z"), _pls(2)),
    "glm_spline_1f": _q(_ROWS.format(_r("my + (d1 + d2) / sqrt(2) / sa * (a - ma) + (d1 - d2) / sqrt(2) / sb * (b - mb)", "forecast"), "x, v"), _spline_1f(25.0, 0.002)).replace("WITH ", "WITH RECURSIVE ", 1),
    "regression_tree_1f": _q(_FORECAST, _tree()),
    "random_forest_1f": _q(_FORECAST, _tree()),
    "random_forest_grid_1f": " UNION ALL ".join(f"(SELECT {k - 1} AS grid_index, {k} AS max_depth, 'all' AS max_features, {_r('1 - sum((y - forecast) * (y - forecast)) / sum(y * y)', 'validation_r2')} FROM ({_q('SELECT * FROM f', _tree(k))}) WHERE split = 'validation')" for k in (1, 2)),
    "gbrt_squares_1f": _q(_ROWS.format(_r("start + 0.5 * (forecast - start)", "forecast"), "f, o"), _tree() + f", o AS ({_LOWER_MEDIAN})"),
    "ensemble_mean": _q(f"SELECT permno, month, {_r('avg(forecast)', 'forecast')}, count(*) AS n_runs FROM forecasts GROUP BY 1, 2"),
    "nn_linear_step": _q(_ROWS.format(_r("w0 + w1 * z1 + w2 * z2", "forecast"), "z, w"), _linear_step()),
    "network_importance": _q(_DROPS.format(_r("base", "baseline_r2"), _r("r2", "ablated_r2"), _r("base - r2", "importance")), _linear_step() + """,
p AS (SELECT y, w0 + w1 * z1 + w2 * z2 AS f, w0 - w1 * m1 / s1 + w2 * z2 AS disc, w0 + w1 * z1 - w2 * m2 / s2 AS qty FROM z, w, s), a AS (SELECT y, f, unnest([{'feature': 'disc', 'g': disc}, {'feature': 'qty', 'g': qty}]) AS r FROM p)"""),
    "boosted_importance": _q(_DROPS.format(_r("base", "baseline_r2"), _r("r2", "ablated_r2"), _r("base - r2", "importance")), _tree() + f""",
o AS ({_LOWER_MEDIAN}), least AS (SELECT forecast AS low FROM f ORDER BY x LIMIT 1), p AS (SELECT y, (start + forecast) / 2 AS f, (start + low) / 2 AS none FROM f, o, least),
a AS (SELECT y, f, unnest([{{'feature': 'trade', 'g': none}}, {{'feature': 'none', 'g': f}}, {{'feature': 'both', 'g': none}}]) AS r FROM p)"""),
    "enet_1f": _q(_ROWS.format(_r("my + b * (disc - m)", "forecast"), "split, b"), _ENET),
}
ORACLES |= {new: ORACLES[old] for new, old in (("rank_pct_spread", "rank_pct_scaled"), ("rank_minmax_spread", "rank_minmax_scaled"), ("deciles_spread", "forecast_deciles"), ("size_groups_spread", "top_bottom_subsample"))}
