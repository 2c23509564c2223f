"""The same questions in SQL, for a second engine: common table expressions and a final select per query."""

from __future__ import annotations

from tailframe.functions.special import normal_point
from tailframe.operators.kernels import multiplicity
from tailframe.operators.schedule import LEVELS

#: The catalogue's simulations: scenarios of each date, and their seed.
SCENARIOS, SEED = 100_000, 20261002
WINDOW, DECAY, STRESS = 504, 0.94, ("stress_1998", "early 1998", "1998-02-01", "1998-04-30")


def r(expression: str, digits: int = 8) -> str:
    return f"round({expression}, {digits}) + 0.0"


def erfc(x: str) -> str:
    """1 - erf by the series exp(-x^2) sum of x^(2k+1) / gamma(k + 3/2), for x >= 0: not the approximation that the engine uses."""
    terms = f"list_sum(list_transform(range(0, 180), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5))))"
    return f"CASE WHEN {x} = 0 THEN 1.0 WHEN {x} > 6.5 THEN 0.0 ELSE 1 - exp(-({x}) * ({x})) * {terms} END"


def two_sided(z: str) -> str:
    return erfc(f"(abs({z}) / sqrt(2.0))")


def holm(p: str, order: str, family: str = "") -> str:
    """The step-down adjusted value as a window expression over a column ``step``, and that step."""
    part = f"PARTITION BY {family} " if family else ""
    return f"least(1.0, max(step) OVER ({part}ORDER BY {p}, {order}))"


def holm_step(p: str, order: str, family: str = "") -> str:
    part = f"PARTITION BY {family} " if family else ""
    return f"{p} * (count(*) OVER ({part.strip()}) - row_number() OVER ({part}ORDER BY {p}, {order}) + 1)"


def intervals(pairs: str) -> str:
    """CTEs: ``bi`` (x, n, low, high), exact binomial intervals of the distinct pairs of a relation, by bisection."""
    tail = lambda x, p: f"coalesce(list_sum(list_transform(range({x}, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})))), 0.0)"
    return f"""
b0 AS (SELECT DISTINCT CAST(x AS BIGINT) AS x, CAST(n AS BIGINT) AS n FROM {pairs}),
b1 AS (SELECT x, n, 0 AS step, CAST(0 AS DOUBLE) AS a0, CAST(1 AS DOUBLE) AS a1, CAST(0 AS DOUBLE) AS c0, CAST(1 AS DOUBLE) AS c1 FROM b0 UNION ALL
  SELECT x, n, step + 1, CASE WHEN under THEN am ELSE a0 END, CASE WHEN under THEN a1 ELSE am END, CASE WHEN above THEN cm ELSE c0 END, CASE WHEN above THEN c1 ELSE cm END
  FROM (SELECT *, {tail('x', 'am')} < 0.025 AS under, 1 - {tail('x + 1', 'cm')} > 0.025 AS above FROM (SELECT *, (a0 + a1) / 2 AS am, (c0 + c1) / 2 AS cm FROM b1 WHERE step < 45))),
bi AS (SELECT x, n, CASE WHEN x = 0 THEN 0.0 ELSE (a0 + a1) / 2 END AS low, CASE WHEN x = n THEN 1.0 ELSE (c0 + c1) / 2 END AS high FROM b1 WHERE step = 45)"""


def level_values() -> str:
    return ", ".join(f"({round(x * 10000)}, CAST({x!r} AS DOUBLE), CAST({normal_point(x)[0]!r} AS DOUBLE), CAST({normal_point(x)[1]!r} AS DOUBLE))" for x in LEVELS)


def draw_values() -> str:
    """How often each position of the pool is drawn: the seeded generator's numbers, as the engine counts them."""
    return ", ".join(f"({p}, {int(n)})" for p, n in enumerate(multiplicity(WINDOW, SCENARIOS, SEED)))


PRIOR = f"ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING"
BASE = f"""
px AS (SELECT CAST(l_shipdate AS DATE) AS session_date, l_returnflag AS asset,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2),
cs AS (SELECT * FROM px WHERE session_date IN (SELECT session_date FROM px GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT asset) FROM px))),
r0 AS (SELECT session_date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY session_date) - 1 AS ret FROM cs),
ret AS (SELECT session_date, CAST(dense_rank() OVER (ORDER BY session_date) - 1 AS INTEGER) AS session_no, asset, CAST(dense_rank() OVER (ORDER BY asset) - 1 AS INTEGER) AS asset_no, ret FROM r0 WHERE ret IS NOT NULL),
n AS (SELECT count(DISTINCT asset) AS n FROM ret),
dy AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS nx FROM (SELECT DISTINCT session_date FROM ret)),
rb AS (SELECT session_date, nx IS NOT NULL AND date_trunc('month', session_date) <> date_trunc('month', nx) AS reb FROM dy),
bl AS (SELECT *, coalesce(sum(CAST(reb AS INTEGER)) OVER (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM rb),
ap AS MATERIALIZED (SELECT ret.*, reb, block, 1.0 / n AS weight, product(1 + ret) OVER (PARTITION BY asset, block ORDER BY session_date) AS after,
  coalesce(product(1 + ret) OVER (PARTITION BY asset, block ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS before FROM ret JOIN bl USING (session_date), n),
bg AS MATERIALIZED (SELECT session_date, block, reb, sum(weight * before) + (1 - sum(weight)) AS g0, sum(weight * after) + (1 - sum(weight)) AS g1 FROM ap GROUP BY 1, 2, 3),
be AS (SELECT block, coalesce(product(grown) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS base FROM (SELECT block, arg_max(g1, session_date) AS grown FROM bg GROUP BY 1)),
tu AS (SELECT session_date, sum(abs(weight - weight * after / g1)) / 2 AS moved FROM ap JOIN bg USING (session_date) GROUP BY 1),
pa AS MATERIALIZED (SELECT session_date, 1e6 * base * g0 AS beginning_value, 1e6 * base * g1 AS ending_value, g1 / g0 - 1 AS portfolio_return, reb, CASE WHEN reb THEN moved ELSE 0.0 END AS turnover FROM bg JOIN be USING (block) JOIN tu USING (session_date)),
wt AS MATERIALIZED (SELECT session_date, asset, asset_no, weight * before / g0 AS bw, weight * after / g1 AS pw FROM ap JOIN bg USING (session_date)),
sc AS (SELECT * FROM (SELECT session_date AS forecast_date, lag(session_date, {WINDOW}) OVER w AS estimation_start_date, lag(session_date, 1) OVER w AS estimation_end_date, portfolio_return AS realized_return, -portfolio_return AS realized_loss FROM pa WINDOW w AS (ORDER BY session_date)) WHERE estimation_start_date IS NOT NULL),
lv(level_bp, confidence_level, z, phi) AS (VALUES {level_values()}),
um AS (SELECT session_date AS forecast_date, avg(portfolio_return) OVER w AS mean_return, stddev_samp(portfolio_return) OVER w AS volatility, count(*) OVER w AS c FROM pa WINDOW w AS (ORDER BY session_date {PRIOR})),
mu AS (SELECT * FROM (SELECT session_date AS forecast_date, session_no, asset_no, avg(ret) OVER w AS mu, ret - avg(ret) OVER w AS u FROM ret WINDOW w AS (PARTITION BY asset_no ORDER BY session_no {PRIOR})) WHERE session_no >= {WINDOW}),
cv AS (SELECT * FROM (SELECT a.session_date AS forecast_date, a.session_no, a.asset_no AS i, b.asset_no AS j, covar_samp(a.ret, b.ret) OVER (PARTITION BY a.asset_no, b.asset_no ORDER BY a.session_no {PRIOR}) AS cov FROM ret a JOIN ret b USING (session_no) WHERE a.asset_no <= b.asset_no) WHERE session_no >= {WINDOW}),
uu AS (SELECT a.session_no, a.forecast_date, a.asset_no AS i, b.asset_no AS j, a.u * b.u AS p FROM mu a JOIN mu b USING (session_no) WHERE a.asset_no <= b.asset_no),
ew AS (SELECT session_no, i, j, cov FROM cv WHERE session_no = {WINDOW} UNION ALL
  SELECT ew.session_no + 1, ew.i, ew.j, {DECAY} * ew.cov + (1 - {DECAY}) * uu.p FROM ew JOIN uu ON uu.session_no = ew.session_no AND uu.i = ew.i AND uu.j = ew.j WHERE ew.session_no + 1 <= (SELECT max(session_no) FROM ret)),
pm AS (SELECT forecast_date, sum(bw * mu) AS mean_return FROM mu JOIN wt ON session_date = forecast_date AND wt.asset_no = mu.asset_no GROUP BY 1),
rv AS (SELECT forecast_date, sum(a.bw * b.bw * cov * CASE WHEN i = j THEN 1.0 ELSE 2.0 END) AS variance FROM cv JOIN wt a ON a.session_date = forecast_date AND a.asset_no = i JOIN wt b ON b.session_date = forecast_date AND b.asset_no = j GROUP BY 1),
ed AS (SELECT forecast_date, ew.* FROM ew JOIN (SELECT DISTINCT session_no, forecast_date FROM mu) USING (session_no)),
ev AS (SELECT forecast_date, sum(a.bw * b.bw * cov * CASE WHEN i = j THEN 1.0 ELSE 2.0 END) AS variance FROM ed JOIN wt a ON a.session_date = forecast_date AND a.asset_no = i JOIN wt b ON b.session_date = forecast_date AND b.asset_no = j GROUP BY 1),
hl AS (SELECT * FROM (SELECT session_date AS forecast_date, list(-portfolio_return) OVER w AS losses, count(*) OVER w AS c FROM pa WINDOW w AS (ORDER BY session_date {PRIOR})) WHERE c = {WINDOW}),
hv AS (SELECT forecast_date, level_bp, confidence_level, losses, list_sort(losses) AS s, ({WINDOW} - 1) * confidence_level AS spot FROM hl, lv),
hq AS (SELECT *, s[CAST(floor(spot) AS INTEGER) + 1] + (s[CAST(floor(spot) AS INTEGER) + 2] - s[CAST(floor(spot) AS INTEGER) + 1]) * (spot - floor(spot)) AS var FROM hv),
hs AS (SELECT forecast_date, level_bp, confidence_level, var AS value_at_risk, list_avg(list_filter(losses, lambda x: x >= var)) AS expected_shortfall FROM hq),
c6 AS (SELECT session_no, max(cov) FILTER (i = 0 AND j = 0) AS c00, max(cov) FILTER (i = 0 AND j = 1) AS c01, max(cov) FILTER (i = 0 AND j = 2) AS c02, max(cov) FILTER (i = 1 AND j = 1) AS c11, max(cov) FILTER (i = 1 AND j = 2) AS c12, max(cov) FILTER (i = 2 AND j = 2) AS c22 FROM ew GROUP BY 1),
f1 AS (SELECT *, sqrt(c00) AS l00, c01 / sqrt(c00) AS l10, c02 / sqrt(c00) AS l20 FROM c6),
f2 AS (SELECT *, sqrt(c11 - l10 * l10) AS l11, (c12 - l20 * l10) / sqrt(c11 - l10 * l10) AS l21 FROM f1),
fc AS (SELECT session_no, l00, l10, l20, l11, l21, sqrt(c22 - l20 * l20 - l21 * l21) AS l22 FROM f2),
in0 AS (SELECT session_no, session_no AS law, asset_no, u FROM mu UNION ALL SELECT ret.session_no, {WINDOW}, ret.asset_no, ret.ret - mu.mu FROM ret JOIN mu ON mu.session_no = {WINDOW} AND mu.asset_no = ret.asset_no WHERE ret.session_no < {WINDOW}),
in3 AS (SELECT session_no, law, max(u) FILTER (asset_no = 0) AS u0, max(u) FILTER (asset_no = 1) AS u1, max(u) FILTER (asset_no = 2) AS u2 FROM in0 GROUP BY 1, 2),
z1 AS (SELECT in3.session_no, u1, u2, l10, l20, l11, l21, l22, u0 / l00 AS z0 FROM in3 JOIN fc ON fc.session_no = law),
z2 AS (SELECT *, (u1 - l10 * z0) / l11 AS z1 FROM z1),
zz AS MATERIALIZED (SELECT session_no, z0, z1, (u2 - l20 * z0 - l21 * z1) / l22 AS z2 FROM z2),
w3 AS (SELECT mu.session_no, mu.forecast_date, sum(bw * mu) AS m, max(bw) FILTER (mu.asset_no = 0) AS w0, max(bw) FILTER (mu.asset_no = 1) AS w1, max(bw) FILTER (mu.asset_no = 2) AS w2 FROM mu JOIN wt ON session_date = forecast_date AND wt.asset_no = mu.asset_no GROUP BY 1, 2),
pull AS (SELECT session_no, forecast_date, m, l00 * w0 + l10 * w1 + l20 * w2 AS a0, l11 * w1 + l21 * w2 AS a1, l22 * w2 AS a2 FROM w3 JOIN fc USING (session_no)),
dr0(p, times) AS (VALUES {draw_values()}),
fl AS MATERIALIZED (SELECT forecast_date, p, times, -(m + z0 * a0 + z1 * a1 + z2 * a2) AS loss FROM pull, dr0 JOIN zz ON zz.session_no = pull.session_no - {WINDOW} + p),
fo AS (SELECT *, sum(times) OVER (PARTITION BY forecast_date ORDER BY loss, p) AS upto FROM fl),
fq AS (SELECT forecast_date, level_bp, confidence_level, ({SCENARIOS} - 1) * confidence_level AS spot, min(loss) FILTER (upto > floor(({SCENARIOS} - 1) * confidence_level)) AS qa, min(loss) FILTER (upto > least(floor(({SCENARIOS} - 1) * confidence_level) + 1, {SCENARIOS} - 1)) AS qb FROM fo, lv GROUP BY ALL),
fv AS (SELECT forecast_date, level_bp, confidence_level, CASE WHEN qa = qb THEN qa ELSE qa + (qb - qa) * (spot - floor(spot)) END AS var FROM fq),
fs AS (SELECT forecast_date, level_bp, confidence_level, var AS value_at_risk, sum(loss * times) FILTER (loss >= var) / sum(times) FILTER (loss >= var) AS expected_shortfall, CAST(sum(times) FILTER (loss >= var) AS BIGINT) AS tail_scenario_count FROM fv JOIN fl USING (forecast_date) GROUP BY 1, 2, 3, 4),
gt AS (SELECT 'rolling-gaussian' AS model, 0 AS model_no, forecast_date, mean_return, sqrt(variance) AS vol FROM pm JOIN rv USING (forecast_date) UNION ALL
  SELECT 'ewma-gaussian', 1, forecast_date, mean_return, sqrt(variance) FROM pm JOIN ev USING (forecast_date)),
tl AS (SELECT model, model_no, forecast_date, level_bp, confidence_level, -mean_return + vol * z AS value_at_risk, -mean_return + vol * phi / (1 - confidence_level) AS expected_shortfall FROM gt, lv UNION ALL
  SELECT 'filtered-historical', 2, forecast_date, level_bp, confidence_level, value_at_risk, expected_shortfall FROM fs),
f AS MATERIALIZED (SELECT tl.*, estimation_start_date, estimation_end_date, realized_return, realized_loss, realized_loss > value_at_risk AS hit FROM tl JOIN sc USING (forecast_date)),
s AS (SELECT *, CASE WHEN hit THEN confidence_level ELSE 1.0 - confidence_level END * abs(realized_loss - value_at_risk) AS ql,
  CASE WHEN hit THEN (realized_loss - value_at_risk) / ((1.0 - confidence_level) * expected_shortfall) ELSE 0.0 END + value_at_risk / expected_shortfall + ln(expected_shortfall) - 1 AS fz,
  value_at_risk + CASE WHEN hit THEN (realized_loss - value_at_risk) / (1.0 - confidence_level) ELSE 0.0 END - expected_shortfall AS id FROM f)
"""
KEY = "model, model_no, level_bp"
#: Calendar years of the test data's forecasts: a second engine's matrix needs its columns named; the query takes them from the data.
YEARS = tuple(f"year_{y}" for y in range(1996, 2002))
COUNTS = f"ec AS (SELECT {KEY}, confidence_level, count(*) AS n, count(*) FILTER (hit) AS x FROM f GROUP BY ALL)"
TRANS = f"""tr AS (SELECT {KEY}, count(*) FILTER (NOT a AND NOT hit) AS n00, count(*) FILTER (NOT a AND hit) AS n01, count(*) FILTER (a AND NOT hit) AS n10, count(*) FILTER (a AND hit) AS n11
  FROM (SELECT *, lag(hit) OVER (PARTITION BY model, level_bp ORDER BY forecast_date) AS a FROM f) GROUP BY ALL)"""


def ll(a: str, b: str, p: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN {a} * ln({p}) ELSE 0.0 END + CASE WHEN {b} > 0 THEN {b} * ln(1 - {p}) ELSE 0.0 END)"


LR = f"""lr AS (SELECT *, greatest(0.0, -2 * ({ll('x', '(n - x)', '(1.0 - confidence_level)')} - {ll('x', '(n - x)', '(x / n)')})) AS uc,
  greatest(0.0, -2 * ({ll('(n01 + n11)', '(n00 + n10)', '((n01 + n11) / (n00 + n01 + n10 + n11))')}
    - CASE WHEN n00 + n01 > 0 THEN {ll('n01', 'n00', '(n01 / (n00 + n01))')} ELSE 0.0 END - CASE WHEN n10 + n11 > 0 THEN {ll('n11', 'n10', '(n11 / (n10 + n11))')} ELSE 0.0 END)) AS ind
  FROM ec JOIN tr USING (model, model_no, level_bp))"""


def newey_west(rows: str, keys: str, lags: str = "", to: str = "nw") -> str:
    """CTEs over a relation ``rows`` (keys, forecast_date, v), the last of them called ``to``; the bandwidth is ``lags`` if given."""
    lags = lags or "floor(4 * pow(n / 100.0, 2.0 / 9.0))"
    return f"""
{to}0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY forecast_date) AS t, count(*) OVER (PARTITION BY {keys}) AS n, avg(v) OVER (PARTITION BY {keys}) AS m FROM {rows}),
{to}1 AS (SELECT *, v - m AS d, CAST(least(n - 1, {lags}) AS BIGINT) AS k_max FROM {to}0),
{to}2 AS (SELECT a.*, k, b.d AS e FROM {to}1 a, LATERAL (SELECT unnest(range(0, a.k_max + 1)) AS k) JOIN {to}1 b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.t = a.t - k),
{to} AS (SELECT {keys}, any_value(n) AS n, any_value(k_max) AS k_max, any_value(m) AS m, greatest(0.0, sum(CASE WHEN k = 0 THEN 1.0 ELSE 2.0 * (1 - k / (k_max + 1.0)) END * d * e / n)) AS omega FROM {to}2 GROUP BY {keys})"""


PERIODS = f"""
yr AS (SELECT year(forecast_date) AS y, min(forecast_date) AS a, max(forecast_date) AS b, count(*) AS n FROM (SELECT DISTINCT forecast_date FROM f) GROUP BY 1),
pe AS (SELECT 'year_' || y AS period_id, 'calendar_year' AS period_type, CAST(y AS VARCHAR) AS label, make_date(y, 1, 1) AS lo, make_date(y, 12, 31) AS hi, a, b, n, n < 0.90 * max(n) OVER () AS is_partial FROM yr UNION ALL
  SELECT '{STRESS[0]}', 'stress', '{STRESS[1]}', DATE '{STRESS[2]}', DATE '{STRESS[3]}', min(forecast_date), max(forecast_date), count(*), false FROM (SELECT DISTINCT forecast_date FROM f WHERE forecast_date BETWEEN DATE '{STRESS[2]}' AND DATE '{STRESS[3]}') HAVING count(*) > 0),
sp AS (SELECT s.*, period_id FROM s JOIN pe ON forecast_date BETWEEN lo AND hi),
ps AS (SELECT period_id, {KEY}, count(*) AS n, avg(ql) AS ql, avg(fz) AS fz FROM sp GROUP BY ALL),
pk AS (SELECT *, rank() OVER (PARTITION BY period_id, level_bp ORDER BY ql) AS rq, rank() OVER (PARTITION BY period_id, level_bp ORDER BY fz) AS rf FROM ps)"""


def sql(select: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([BASE.strip(), *more])} {select}"


def severity(key: str, rows: str) -> str:
    return f"""SELECT {key}, count(*) AS observation_count, count(*) FILTER (hit) AS exceedance_count, {r('avg(realized_loss) FILTER (hit)')} AS mean_loss, {r('avg(value_at_risk) FILTER (hit)')} AS mean_value_at_risk,
  {r('avg(expected_shortfall) FILTER (hit)')} AS mean_expected_shortfall, {r('avg(realized_loss - value_at_risk) FILTER (hit)')} AS mean_excess, {r('median(realized_loss - value_at_risk) FILTER (hit)')} AS median_excess,
  {r('max(realized_loss - value_at_risk) FILTER (hit)')} AS max_excess, {r('avg(realized_loss - expected_shortfall) FILTER (hit)')} AS mean_severity_gap FROM {rows} GROUP BY {key}"""


DM_ROWS = """
sl AS (SELECT 'quantile_loss' AS score_name, model, model_no, level_bp, forecast_date, ql AS s FROM s UNION ALL SELECT 'fz0_loss', model, model_no, level_bp, forecast_date, fz FROM s),
dr AS (SELECT a.score_name, a.level_bp, a.model AS model_a, b.model AS model_b, a.model_no AS a, b.model_no AS b, CASE a.score_name WHEN 'quantile_loss' THEN 0 ELSE 1 END AS score_no, a.forecast_date, a.s - b.s AS v FROM sl a JOIN sl b ON a.score_name = b.score_name AND a.level_bp = b.level_bp AND a.forecast_date = b.forecast_date AND a.model_no < b.model_no)"""
DM_KEY = "score_no, score_name, level_bp, a, b, model_a, model_b"


def tested(source: str, to: str) -> str:
    """CTE ``to``: the statistics of ``source`` with their p-values and the adjusted ones, by score."""
    order = "level_bp, a, b"
    return f"""{to} AS (SELECT *, {holm('p', order, 'score_name')} AS hp FROM (SELECT *, {holm_step('p', order, 'score_name')} AS step FROM (SELECT *, {two_sided('st')} AS p FROM (SELECT *, sqrt(omega / n) AS se, m / sqrt(omega / n) AS st FROM {source}))))"""


TRAFFIC = f"""
tp AS (SELECT * FROM (SELECT model, model_no, forecast_date, first_value(forecast_date) OVER w AS window_start_date, count(*) OVER w AS c, CAST(sum(CAST(hit AS INTEGER)) OVER w AS BIGINT) AS exception_count FROM f WHERE level_bp = 9900
  WINDOW w AS (PARTITION BY model ORDER BY forecast_date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)) WHERE c = 250),
tz AS (SELECT *, CASE WHEN exception_count <= 4 THEN 'green' WHEN exception_count <= 9 THEN 'amber' ELSE 'red' END AS zone FROM tp)"""

#: The stress period's pools, rescaled by each date's factor.
RESCALED = f"""
m3 AS (SELECT session_no, forecast_date, max(mu) FILTER (asset_no = 0) AS m0, max(mu) FILTER (asset_no = 1) AS m1, max(mu) FILTER (asset_no = 2) AS m2 FROM mu WHERE forecast_date BETWEEN DATE '{STRESS[2]}' AND DATE '{STRESS[3]}' GROUP BY 1, 2),
rs AS (SELECT forecast_date, p, times, unnest([0, 1, 2]) AS asset_no, unnest([m0 + l00 * z0, m1 + l10 * z0 + l11 * z1, m2 + l20 * z0 + l21 * z1 + l22 * z2]) AS ret FROM m3 JOIN fc USING (session_no), dr0 JOIN zz ON zz.session_no = m3.session_no - {WINDOW} + p)"""
#: The order lines as long market data.
QUOTES = """SELECT session_date, asset, unnest(['Adj Close', 'Volume']) AS field, unnest([paid / units, units]) AS value FROM (SELECT CAST(l_shipdate AS DATE) AS session_date, l_returnflag AS asset,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS paid, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units FROM lineitem GROUP BY 1, 2)"""

ORACLES = {
    "asset_returns": sql(f"SELECT session_date, session_no, asset, asset_no, {r('ret')} AS ret FROM ret"),
    "large_return_flags": sql(f"SELECT session_date, asset, {r('ret')} AS ret, abs(ret) >= 0.5 AS flag FROM ret"),
    "missing_price_counts": """WITH p AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, c_mktsegment AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
      SELECT x.a AS asset, count(*) FILTER (p.a IS NULL) AS missing FROM (SELECT * FROM (SELECT DISTINCT d FROM p), (SELECT DISTINCT a FROM p)) x LEFT JOIN p ON p.d = x.d AND p.a = x.a GROUP BY 1""",
    "complete_sessions": sql(f"SELECT session_date, asset, {r('price', 6)} AS price FROM cs"),
    "segment_returns": f"""WITH p AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, c_mktsegment AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      g AS (SELECT x.d, x.a, price FROM (SELECT * FROM (SELECT DISTINCT d FROM p), (SELECT DISTINCT a FROM p)) x LEFT JOIN p ON p.d = x.d AND p.a = x.a)
      SELECT d AS session_date, a AS asset, {r('price / lag(price) OVER (PARTITION BY a ORDER BY d) - 1')} AS ret FROM g""",
    "return_diagnostics": sql(f"""SELECT count(*) AS observation_count, {r('avg(x)')} AS mean_return, {r('var_samp(x)')} AS variance, {r('stddev_samp(x)')} AS volatility, {r('avg(x) * 252')} AS annualized_mean_return, {r('stddev_samp(x) * sqrt(252.0)')} AS annualized_volatility,
      {r('skewness(x)', 6)} AS skewness, {r('kurtosis(x)', 6)} AS excess_kurtosis, {r('min(x)')} AS worst_return, arg_min(session_date, (x, session_date)) AS worst_date, {r('max(x)')} AS best_return, arg_min(session_date, (-x, session_date)) AS best_date,
      {r('quantile_cont(-x, 0.95)')} AS loss_q950, {r('quantile_cont(-x, 0.975)')} AS loss_q975, {r('quantile_cont(-x, 0.99)')} AS loss_q990 FROM (SELECT session_date, portfolio_return AS x FROM pa)"""),
    "equal_weights": sql(f"SELECT DISTINCT asset, {r('0.9 / n')} AS weight FROM ret, n"),
    "portfolio_path": sql(f"SELECT session_date, {r('ln(beginning_value)')} AS log_beginning_value, {r('portfolio_return')} AS portfolio_return, {r('ln(ending_value)')} AS log_ending_value, ending_value < beginning_value AS lost, reb AS rebalanced_after_close, {r('turnover')} AS turnover FROM pa"),
    "portfolio_weights": sql(f"SELECT session_date, asset, {r('bw')} AS begin_weight, {r('pw')} AS pre_rebalance_weight FROM wt"),
    "rebalance_summary": sql(f"SELECT count(*) FILTER (reb) AS rebalance_count, {r('sum(turnover)', 6)} AS total_turnover FROM pa"),
    "forecast_schedule": sql(f"SELECT forecast_date, estimation_start_date, estimation_end_date, {r('realized_return')} AS realized_return, {r('realized_loss')} AS realized_loss FROM sc"),
    "forecast_grid": sql("SELECT forecast_date, level_bp, confidence_level FROM sc, lv"),
    "rolling_moments": sql(f"SELECT forecast_date, asset_no, {r('mu')} AS mu, {r('u')} AS u FROM mu"),
    "rolling_covariance": sql(f"SELECT forecast_date, i, j, {r('cov')} AS cov FROM cv"),
    "ewma_covariance": sql(f"SELECT forecast_date, i, j, {r('cov')} AS cov FROM ed"),
    "portfolio_moments": sql(f"SELECT forecast_date, {r('mean_return')} AS mean_return, {r('variance')} AS variance, {r('sqrt(variance)')} AS volatility FROM pm JOIN rv USING (forecast_date)"),
    "rolling_gaussian_univariate": sql(f"SELECT forecast_date, level_bp, {r('mean_return')} AS mean_return, {r('volatility')} AS volatility, {r('-mean_return + volatility * z')} AS value_at_risk, {r('-mean_return + volatility * phi / (1 - confidence_level)')} AS expected_shortfall FROM um, lv WHERE c = {WINDOW}"),
    **{name: sql(f"SELECT forecast_date, level_bp, {r('value_at_risk')} AS value_at_risk, {r('expected_shortfall')} AS expected_shortfall FROM tl WHERE model_no = {no}") for name, no in (("rolling_gaussian_multivariate", 0), ("ewma_gaussian", 1))},
    "historical_simulation": sql(f"SELECT forecast_date, level_bp, {r('value_at_risk')} AS value_at_risk, {r('expected_shortfall')} AS expected_shortfall FROM hs"),
    "forecasts": sql(f"SELECT model, forecast_date, level_bp, estimation_start_date, estimation_end_date, {r('realized_loss')} AS realized_loss, {r('value_at_risk')} AS value_at_risk, {r('expected_shortfall')} AS expected_shortfall, hit AS var_exceedance FROM f"),
    "var_exceedances": sql(f"SELECT {KEY}, n AS observation_count, x AS observed_count, {r('1.0 - confidence_level')} AS expected_rate, {r('x / n')} AS observed_rate, {r('(1.0 - confidence_level) * n')} AS expected_count, {r('x - (1.0 - confidence_level) * n')} AS count_difference FROM ec", COUNTS),
    "es_tail_severity": sql(severity(KEY, "f")),
    "quantile_losses": sql(f"SELECT model, level_bp, forecast_date, {r('ql')} AS quantile_loss FROM s"),
    "fz0_losses": sql(f"SELECT model, level_bp, forecast_date, {r('fz', 6)} AS fz0_loss FROM s"),
    "identification_residuals": sql(f"SELECT model, level_bp, forecast_date, {r('id', 6)} AS identification FROM s"),
    "quantile_loss_rank": sql(f"SELECT {KEY}, count(*) AS observation_count, {r('avg(ql)')} AS mean_quantile_loss, rank() OVER (PARTITION BY level_bp ORDER BY avg(ql)) AS rank FROM s GROUP BY {KEY}"),
    "fz0_rank": sql(f"SELECT {KEY}, count(*) AS observation_count, {r('avg(fz)')} AS mean_fz0_loss, rank() OVER (PARTITION BY level_bp ORDER BY avg(fz)) AS rank FROM s GROUP BY {KEY}"),
    "exceedance_transitions": sql("SELECT * FROM tr", TRANS),
    "coverage_likelihood_ratios": sql(f"SELECT {KEY}, {r('uc', 6)} AS lr_unconditional, {r('ind', 6)} AS lr_independence, {r('uc + ind', 6)} AS lr_conditional, {r('exp(-(uc + ind) / 2)')} AS p_conditional, exp(-(uc + ind) / 2) < 0.05 AS reject_conditional FROM lr", COUNTS, TRANS, LR),
    "coverage_holm": sql(f"SELECT {KEY}, {r('least(1.0, max(step) OVER (ORDER BY p, model_no, level_bp))')} AS holm_p_value, least(1.0, max(step) OVER (ORDER BY p, model_no, level_bp)) < 0.05 AS holm_reject FROM (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model_no, level_bp) + 1) AS step FROM (SELECT *, exp(-(uc + ind) / 2) AS p FROM lr))", COUNTS, TRANS, LR),
    "var_es_calibration": sql(f"SELECT {KEY}, n AS observation_count, k_max AS bandwidth, {r('m', 6)} AS mean, {r('omega', 6)} AS long_run_variance, {r('sqrt(omega / n)', 6)} AS standard_error, {r('m / sqrt(omega / n)', 6)} AS statistic FROM nw", f"ci AS (SELECT {KEY}, forecast_date, id AS v FROM s)", newey_west("ci", KEY)),
    "diebold_mariano": sql(f"SELECT score_name, level_bp, model_a, model_b, n AS observation_count, k_max AS bandwidth, {r('m', 6)} AS mean, {r('sqrt(omega / n)', 6)} AS standard_error, {r('m / sqrt(omega / n)', 6)} AS statistic FROM nw", DM_ROWS, newey_west("dr", "score_name, level_bp, model_a, model_b")),
    "traffic_light_path": sql("SELECT model, forecast_date, window_start_date, exception_count, zone FROM tz", TRAFFIC),
    "traffic_light_summary": sql(f"""SELECT model, count(*) AS window_count, count(*) FILTER (zone = 'green') AS green_count, count(*) FILTER (zone = 'amber') AS amber_count, count(*) FILTER (zone = 'red') AS red_count,
      {r("count(*) FILTER (zone = 'green') / count(*)")} AS green_rate, {r("count(*) FILTER (zone = 'amber') / count(*)")} AS amber_rate, {r("count(*) FILTER (zone = 'red') / count(*)")} AS red_rate, arg_max(exception_count, forecast_date) AS latest_count,
      arg_max(zone, forecast_date) AS latest_zone, max(exception_count) AS max_count, arg_min(forecast_date, (-exception_count, forecast_date)) AS first_max_date, min(forecast_date) FILTER (zone = 'amber') AS first_amber_date, min(forecast_date) FILTER (zone = 'red') AS first_red_date FROM tz GROUP BY model""", TRAFFIC),
    "subperiod_definitions": sql("SELECT period_id, period_type, label, lo AS requested_start_date, hi AS requested_end_date, a AS first_forecast_date, b AS last_forecast_date, n AS observation_count, is_partial FROM pe", PERIODS),
    "subperiod_coverage": sql(f"""SELECT period_id, {KEY}, count(*) AS observation_count, count(*) FILTER (hit) AS observed_count, {r('count(*) FILTER (hit) / count(*)')} AS observed_rate, {r('avg(value_at_risk)')} AS mean_value_at_risk, {r('avg(expected_shortfall)')} AS mean_expected_shortfall,
      (1.0 - confidence_level) * count(*) < 5 AS sparse_expected, count(*) FILTER (hit) < 5 AS sparse_observed FROM sp GROUP BY period_id, {KEY}, confidence_level""", PERIODS),
    "subperiod_severity": sql(severity(f"period_id, {KEY}", "sp"), PERIODS),
    "subperiod_calibration": sql(f"SELECT period_id, {KEY}, count(*) AS observation_count, {r('avg(id)', 6)} AS mean_identification FROM sp GROUP BY period_id, {KEY}", PERIODS),
    "subperiod_scores": sql(f"SELECT period_id, {KEY}, n AS observation_count, {r('ql')} AS mean_quantile_loss, {r('fz', 6)} AS mean_fz0_loss, rq AS quantile_loss_rank, rf AS fz0_loss_rank FROM pk", PERIODS),
    "first_place_counts": sql("SELECT score_name, level_bp, model, count(*) FILTER (k = 1) AS first_places FROM (SELECT 'quantile_loss' AS score_name, level_bp, model, rq AS k FROM pk WHERE starts_with(period_id, 'year_') UNION ALL SELECT 'fz0_loss', level_bp, model, rf FROM pk WHERE starts_with(period_id, 'year_')) GROUP BY ALL", PERIODS),
    "exception_rate_matrix": sql("SELECT level_bp, model, " + ", ".join(r(f"max(g) FILTER (period_id = '{p}')") + f" AS {p}" for p in (*YEARS, STRESS[0])) + f" FROM (SELECT period_id, {KEY}, count(*) FILTER (hit) / count(*) - (1.0 - confidence_level) AS g FROM sp GROUP BY period_id, {KEY}, confidence_level) GROUP BY ALL", PERIODS),
    "full_sample_scores": sql(f"SELECT {KEY}, CAST(sum(n) AS BIGINT) AS observation_count, {r('sum(n * ql) / sum(n)')} AS mean_quantile_loss, {r('sum(n * fz) / sum(n)', 6)} AS mean_fz0_loss FROM ps WHERE starts_with(period_id, 'year_') GROUP BY {KEY}", PERIODS),
    "rank_matrix": sql("SELECT score_name, level_bp, model, " + ", ".join(f"max(k) FILTER (period_id = '{p}') AS {p}" for p in YEARS) + " FROM (SELECT 'quantile_loss' AS score_name, level_bp, model, period_id, rq AS k FROM pk UNION ALL SELECT 'fz0_loss', level_bp, model, period_id, rf FROM pk) GROUP BY ALL", PERIODS),
    "exact_binomial_interval": sql(f"""SELECT {KEY}, confidence_level, n AS observation_count, x AS observed_count, {r('1.0 - confidence_level')} AS expected_rate, {r('x / n')} AS observed_rate, {r('(1.0 - confidence_level) * n')} AS expected_count,
      {r('x - (1.0 - confidence_level) * n')} AS count_difference, {r('low')} AS rate_lower, {r('high')} AS rate_upper FROM ec JOIN bi USING (x, n)""", COUNTS, intervals("ec")),
    "coverage_report": sql(f"""SELECT {KEY}, confidence_level, n AS observation_count, x AS observed_count, {r('1.0 - confidence_level')} AS expected_rate, {r('x / n')} AS observed_rate, {r('(1.0 - confidence_level) * n')} AS expected_count, {r('x - (1.0 - confidence_level) * n')} AS count_difference,
      n00, n01, n10, n11, {r('uc', 6)} AS lr_unconditional, {r('ind', 6)} AS lr_independence, {r('uc + ind', 6)} AS lr_conditional, {r('(n01 + n11) / (n00 + n01 + n10 + n11)')} AS transition_rate, {r('CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) END')} AS rate_after_normal,
      {r('CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) END')} AS rate_after_exceedance, {r('pu')} AS p_unconditional, {r('pi')} AS p_independence, {r('pc')} AS p_conditional, pu < 0.05 AS reject_unconditional, pi < 0.05 AS reject_independence, pc < 0.05 AS reject_conditional,
      {r(holm('pc', 'model_no, level_bp'))} AS holm_p_value, {holm('pc', 'model_no, level_bp')} < 0.05 AS holm_reject, {r('low')} AS rate_lower, {r('high')} AS rate_upper
      FROM (SELECT *, {holm_step('pc', 'model_no, level_bp')} AS step FROM (SELECT *, {erfc('sqrt(uc / 2)')} AS pu, {erfc('sqrt(ind / 2)')} AS pi, exp(-(uc + ind) / 2) AS pc FROM lr)) JOIN bi USING (x, n)""", COUNTS, TRANS, LR, intervals("ec")),
    "calibration_report": sql(f"""SELECT {KEY}, confidence_level, n AS observation_count, k_max AS bandwidth, {r('m', 6)} AS mean, {r('omega', 6)} AS long_run_variance, {r('se', 6)} AS standard_error, {r('st', 6)} AS statistic, {r('p', 6)} AS p_value, p < 0.05 AS reject,
      {r(holm('p', 'model_no, level_bp'), 6)} AS holm_p_value, {holm('p', 'model_no, level_bp')} < 0.05 AS holm_reject
      FROM (SELECT *, {holm_step('p', 'model_no, level_bp')} AS step FROM (SELECT *, {two_sided('st')} AS p FROM (SELECT *, sqrt(omega / n) AS se, m / sqrt(omega / n) AS st FROM nw))) JOIN lv USING (level_bp)""", f"ci AS (SELECT {KEY}, forecast_date, id AS v FROM s)", newey_west("ci", KEY)),
    "dm_report": sql(f"""SELECT score_no, score_name, level_bp, confidence_level, a, b, model_a, model_b, n AS observation_count, k_max AS bandwidth, {r('m', 6)} AS mean, {r('omega', 6)} AS long_run_variance, {r('se', 6)} AS standard_error, {r('st', 6)} AS statistic, {r('p', 6)} AS p_value, p < 0.05 AS reject,
      {r('hp', 6)} AS holm_p_value, hp < 0.05 AS holm_reject FROM da JOIN lv USING (level_bp)""", DM_ROWS, newey_west("dr", DM_KEY), tested("nw", "da")),
    "oriented_inference": sql(f"""SELECT score_name, level_bp, pair_no, model, reference, {r('mm', 6)} AS model_mean, {r('rm', 6)} AS reference_mean, {r('g', 6)} AS mean_difference, {r("CASE WHEN score_name = 'quantile_loss' THEN 100 * g / rm END", 6)} AS percent_difference, {r('t * st', 6)} AS statistic,
      {r('p', 6)} AS p_value, {r('hp', 6)} AS holm_p_value, hp < 0.05 AS holm_reject, CASE WHEN g < 0 THEN model WHEN g > 0 THEN reference END AS lower_score_model, {r('t * st0', 6)} AS plain_statistic, {r('hp0', 6)} AS plain_holm_p_value, hp0 < 0.05 AS plain_reject,
      (hp < 0.05) <> (hp0 < 0.05) AS decision_changed, CASE WHEN hp < 0.001 THEN '<0.001' ELSE printf('%.3f', hp) END AS p_label
      FROM (SELECT da.*, st0, hp0, pair_no, wanted.model, wanted.reference, fa.s AS mm, fb.s AS rm, CASE WHEN model_a = wanted.model THEN 1.0 ELSE -1.0 END AS t, CASE WHEN model_a = wanted.model THEN 1.0 ELSE -1.0 END * da.m AS g
        FROM da JOIN (SELECT score_name, level_bp, a, b, st AS st0, hp AS hp0 FROM dz) USING (score_name, level_bp, a, b) JOIN wanted ON (model_a = wanted.model AND model_b = wanted.reference) OR (model_a = wanted.reference AND model_b = wanted.model)
        JOIN fm fa ON fa.model = wanted.model AND fa.level_bp = da.level_bp AND fa.score_name = da.score_name JOIN fm fb ON fb.model = wanted.reference AND fb.level_bp = da.level_bp AND fb.score_name = da.score_name)""",
      PERIODS, DM_ROWS, newey_west("dr", DM_KEY), tested("nw", "da"), newey_west("dr", DM_KEY, "0", "nz"), tested("nz", "dz"),
      "wanted(pair_no, model, reference) AS (VALUES (0, 'ewma-gaussian', 'rolling-gaussian'), (1, 'filtered-historical', 'rolling-gaussian'), (2, 'filtered-historical', 'ewma-gaussian'))",
      "fm AS (SELECT 'quantile_loss' AS score_name, model, level_bp, sum(n * ql) / sum(n) AS s FROM ps WHERE starts_with(period_id, 'year_') GROUP BY 2, 3 UNION ALL SELECT 'fz0_loss', model, level_bp, sum(n * fz) / sum(n) FROM ps WHERE starts_with(period_id, 'year_') GROUP BY 2, 3)"),
    "subperiod_intervals": sql(f"SELECT period_id, {KEY}, confidence_level, n AS observation_count, {r('x / n')} AS observed_rate, {r('1.0 - confidence_level')} AS expected_rate, {r('low')} AS rate_lower, {r('high')} AS rate_upper FROM pc JOIN bi USING (x, n)", PERIODS,
      f"pc AS (SELECT period_id, {KEY}, confidence_level, count(*) AS n, count(*) FILTER (hit) AS x FROM sp GROUP BY ALL)", intervals("pc")),
    "rank_by_period": sql("SELECT 'quantile_loss' AS score_name, level_bp, model, period_id, rq AS rank FROM pk UNION ALL SELECT 'fz0_loss', level_bp, model, period_id, rf FROM pk", PERIODS),
    "exception_rate_by_period": sql(f"SELECT level_bp, model, period_id, {r('count(*) FILTER (hit) / count(*) - (1.0 - confidence_level)')} AS rate_gap FROM sp GROUP BY period_id, {KEY}, confidence_level", PERIODS),
    "binomial_reference_band": sql("""SELECT sessions, level_bp, min(k) FILTER (c >= 0.025) / sessions AS rate_lower, min(k) FILTER (c >= 0.975) / sessions AS rate_upper FROM cu GROUP BY 1, 2""", PERIODS, """
      t AS (SELECT DISTINCT n AS sessions FROM pe),
      pb AS (SELECT sessions, level_bp, k, exp(lgamma(sessions + 1) - lgamma(k + 1) - lgamma(sessions - k + 1) + k * ln(1 - confidence_level) + (sessions - k) * ln(confidence_level)) AS q FROM t, lv, LATERAL (SELECT unnest(range(0, sessions + 1)) AS k)),
      cu AS (SELECT *, sum(q) OVER (PARTITION BY sessions, level_bp ORDER BY k) AS c FROM pb)"""),
    "fhs_multiplicity": sql(f"SELECT p AS pool_position, session_date AS residual_date, CAST(times AS BIGINT) AS draws FROM dr0 JOIN (SELECT DISTINCT session_no, session_date FROM ret) ON session_no = (SELECT max(session_no) FROM ret) - {WINDOW} + p"),
    "loss_tails": f"""WITH l AS (SELECT l_returnflag AS flag, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS loss, unnest(range(CAST(l_quantity AS BIGINT))) AS unit FROM lineitem),
      v AS ({' UNION ALL '.join(f"SELECT flag, {round(x * 10000)} AS level_bp, quantile_cont(loss, {x!r}) AS var, count(*) AS n FROM l GROUP BY flag" for x in LEVELS)})
      SELECT v.flag, level_bp, n AS observation_count, count(*) AS tail_count, {r('var', 6)} AS value_at_risk, {r('avg(loss)', 6)} AS expected_shortfall FROM v JOIN l ON l.flag = v.flag AND loss >= var GROUP BY v.flag, level_bp, n, var""",
    "market_quotes": f"""WITH q AS ({QUOTES}) SELECT session_date, asset, field, {r('value', 6)} AS value FROM q""",
    "market_coverage": f"""WITH q AS ({QUOTES}), d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS no FROM (SELECT DISTINCT session_date FROM q))
      SELECT CASE grouping(asset, field) WHEN 0 THEN 'asset_field' WHEN 1 THEN 'asset' WHEN 2 THEN 'field' ELSE 'table' END AS scope, asset, field, count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(DISTINCT no) AS sessions, max(no) - min(no) + 1 - count(DISTINCT no) AS gaps,
      min(session_date) AS first_date, max(session_date) AS last_date, {r('min(value)', 6)} AS lowest, {r('max(value)', 6)} AS highest FROM q JOIN d USING (session_date) GROUP BY GROUPING SETS ((asset, field), (asset), (field), ())""",
    "forecast_contract": sql("SELECT rule, n AS rows_checked, broken AS rows_broken FROM (SELECT n, unnest(names) AS rule, unnest(counts) AS broken FROM rc)", f"""
      gr AS (SELECT model, level_bp, sc.forecast_date AS forecast_date FROM (SELECT DISTINCT model FROM f), lv, sc),
      fg AS (SELECT model, level_bp, forecast_date, count(*) AS c FROM f GROUP BY ALL),
      ck AS (SELECT coalesce(c, 0) AS c, f.*, sc.estimation_start_date AS s0, sc.estimation_end_date AS s1, sc.realized_return AS sr FROM gr FULL JOIN fg USING (model, level_bp, forecast_date) LEFT JOIN f USING (model, level_bp, forecast_date) LEFT JOIN sc USING (forecast_date)),
      rc AS (SELECT count(*) AS n, ['forecast is missing', 'model, date and level repeat', 'date or window is not the schedule''s', 'window reaches the forecast date', 'level is unknown', 'number is not finite', 'outcome is not the schedule''s', 'loss is not minus return', 'ES is below VaR', 'flag does not match'] AS names,
        [count(*) FILTER (c = 0), count(*) FILTER (c > 1), count(*) FILTER (c > 0 AND (s0 IS NULL OR estimation_start_date <> s0 OR estimation_end_date <> s1)), count(*) FILTER (c > 0 AND estimation_end_date >= forecast_date), count(*) FILTER (c > 0 AND level_bp NOT IN (SELECT level_bp FROM lv)),
         count(*) FILTER (c > 0 AND NOT (isfinite(realized_return) AND isfinite(realized_loss) AND isfinite(value_at_risk) AND isfinite(expected_shortfall))), count(*) FILTER (c > 0 AND abs(realized_return - sr) > 1e-15 + 1e-12 * abs(sr)), count(*) FILTER (c > 0 AND realized_loss <> -realized_return),
         count(*) FILTER (c > 0 AND expected_shortfall < value_at_risk - 1e-12), count(*) FILTER (c > 0 AND hit <> (realized_loss > value_at_risk))] AS counts FROM ck)"""),
    "filtered_scenarios": sql(f"SELECT forecast_date, p AS pool_position, CAST(times AS BIGINT) AS draws, asset_no, {r('ret')} AS ret FROM rs", RESCALED),
    "filtered_losses": sql(f"SELECT rs.forecast_date, p AS pool_position, CAST(times AS BIGINT) AS draws, {r('-sum(bw * ret)')} AS loss FROM rs JOIN wt ON session_date = rs.forecast_date AND wt.asset_no = rs.asset_no GROUP BY ALL", RESCALED),
    "companion_scores": sql(f"SELECT period_id, period_type, model, confidence_level, n AS observation_count, {r('ql')} AS mean_var_quantile_loss, rq AS var_quantile_loss_rank, {r('fz', 6)} AS mean_fz0_loss, rf AS fz0_loss_rank FROM pk JOIN (SELECT period_id, period_type FROM pe) USING (period_id) JOIN (SELECT level_bp, confidence_level FROM lv) USING (level_bp)", PERIODS),
    "standardized_residuals": sql(f"SELECT session_date AS residual_date, asset_no, {r('z')} AS z FROM (SELECT session_no, unnest([0, 1, 2]) AS asset_no, unnest([z0, z1, z2]) AS z FROM zz) JOIN (SELECT DISTINCT session_no, session_date FROM ret) USING (session_no)"),
    "residual_pool_window": sql(f"SELECT forecast_date, {WINDOW} AS pool_size, estimation_start_date AS pool_start_date, estimation_end_date AS pool_end_date FROM sc"),
    "fhs_forecasts": sql(f"""SELECT forecast_date, level_bp, confidence_level, {r('mean')} AS simulated_mean_return, {r('sqrt(v)')} AS simulated_volatility, CAST({SCENARIOS} AS BIGINT) AS scenario_count, CAST({SEED} AS BIGINT) AS random_seed, tail_scenario_count,
      {r('value_at_risk')} AS value_at_risk, {r('expected_shortfall')} AS expected_shortfall FROM fs JOIN (SELECT forecast_date, any_value(mean) AS mean, sum(times * (loss + mean) * (loss + mean)) / ({SCENARIOS} - 1) AS v FROM fl JOIN (SELECT forecast_date, -sum(loss * times) / {SCENARIOS} AS mean FROM fl GROUP BY 1) USING (forecast_date) GROUP BY 1) USING (forecast_date)"""),
    "complete_segment_returns": f"""WITH p AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, c_mktsegment AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      g AS (SELECT x.d, x.a, price FROM (SELECT * FROM (SELECT DISTINCT d FROM p), (SELECT DISTINCT a FROM p)) x LEFT JOIN p ON p.d = x.d AND p.a = x.a),
      q AS (SELECT d, a, price / lag(price) OVER (PARTITION BY a ORDER BY d) - 1 AS ret FROM g),
      k AS (SELECT * FROM q WHERE d IN (SELECT d FROM q GROUP BY 1 HAVING count(ret) = (SELECT count(DISTINCT a) FROM q)))
      SELECT d AS session_date, CAST(dense_rank() OVER (ORDER BY d) - 1 AS INTEGER) AS session_no, a AS asset, CAST(dense_rank() OVER (ORDER BY a) - 1 AS INTEGER) AS asset_no, {r('ret')} AS ret FROM k""",
}
