"""DuckDB SQL for the queries that SQL can express, written independently of the operators' plans."""

from __future__ import annotations

import re
from statistics import NormalDist

from tessera.plans import queries as q

_Z = NormalDist().inv_cdf(1 - q.CONFIDENCE)
_PDF = NormalDist().pdf(_Z)
#: Midpoints of the tail, in 200 parts.
_TAIL = f"[{', '.join(repr(NormalDist().inv_cdf((1 - q.CONFIDENCE) * (i + 0.5) / 200)) for i in range(200))}]::DOUBLE[]"
STYLES = ("value", "momentum", "size", "quality", "low_vol")
RAW = ("bp", "ep", "log_mcap", "gp_assets", "leverage", "momentum", "vol")


def prices(symbol: str = "p_type", period: str = "week") -> str:
    return f"""raw AS (
  SELECT {symbol} AS symbol, date_trunc('{period}', l_shipdate)::DATE AS date, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(l_extendedprice)) AS px, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), bars AS (
  SELECT symbol, date, avg(px) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS close,
    row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM raw
), prices AS (SELECT symbol, date, close, CASE WHEN n % 7 <> 0 THEN close END AS adj_close FROM bars
), px AS (SELECT symbol, date, coalesce(adj_close, close) AS px FROM prices)"""


def rets(symbol: str = "p_type", period: str = "week") -> str:
    return prices(symbol, period) + """, shared AS (
  SELECT date FROM px GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM px)
), moved AS (
  SELECT symbol, date, px / lag(px) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px WHERE date IN (SELECT date FROM shared)
), ret AS (SELECT * FROM moved WHERE r IS NOT NULL)"""


def apart(ctes: str) -> str:
    """The same tables under names that start with t_, to stand beside others."""
    for name in ("raw", "bars", "prices", "px", "shared", "moved", "ret"):
        ctes = re.sub(rf"\b{name}(?= AS \()|(?<=FROM ){name}\b", f"t_{name}", ctes)
    return ctes


def book(rows: str = "ret") -> str:
    """eq: 1/N; w: in proportion to alphabetical place."""
    return f""", names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM {rows})
), eq AS (SELECT symbol, 1.0::DOUBLE / (SELECT count(*) FROM names) AS weight FROM names
), w AS (SELECT symbol, i::DOUBLE / (SELECT sum(i) FROM names) AS weight FROM names)"""


def series(weights: str = "w", name: str = "ser") -> str:
    return f", {name} AS (SELECT date, sum(weight * r) AS r FROM ret JOIN {weights} USING (symbol) GROUP BY date)"


WEEK = rets() + book() + series()
DAY = rets("p_type", "day") + book() + series("eq")
EQUITY = """, grown AS (SELECT date, r, product(1 + r) OVER (ORDER BY date) AS equity FROM ser
), eqty AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM grown)"""
SUMMARY = """count(r) AS n, CASE WHEN count(r) >= 2 THEN product(1 + r) ** (252.0::DOUBLE / count(r)) - 1 END AS cagr, stddev_samp(r) * sqrt(252) AS vol,
  avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, min(equity / peak - 1) AS max_drawdown"""


def final(ctes: str, cols: dict[str, str | None], source: str, places: int | dict[str, int] = 8, tail: str = "") -> str:
    """cols: name -> SQL (None: itself); a name that ends with ! isn't rounded."""
    out = []
    for name, sql in cols.items():
        plain = name.endswith("!")
        name = name.rstrip("!")
        sql = sql or name
        out.append(f"{sql} AS {name}" if plain else f"round(({sql})::DOUBLE, {places}) + 0.0 AS {name}")
    return f"WITH {ctes}\nSELECT {', '.join(out)} FROM {source} {tail}"


PAIRS = """, pair AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, a.date, a.r AS ri, b.r AS rj FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol)"""
COV = PAIRS + ", cov AS (SELECT sym_i, sym_j, covar_samp(ri, rj) AS cov FROM pair GROUP BY 1, 2)"
FULL = ", fullcov AS (SELECT sym_i, sym_j, 52 * cov AS cov FROM cov UNION ALL SELECT sym_j, sym_i, 52 * cov FROM cov WHERE sym_i < sym_j)"
IMPLIED = FULL + ", implied AS (SELECT sym_i AS symbol, 2.5 * sum(cov * weight) AS implied FROM fullcov JOIN w ON sym_j = w.symbol GROUP BY 1)"
SHRINK = """, dm AS (SELECT symbol, date, r - avg(r) OVER (PARTITION BY symbol) AS r FROM ret
), emp AS (
  SELECT a.symbol AS sym_i, b.symbol AS sym_j, avg(a.r * b.r) AS s, avg(a.r * a.r * b.r * b.r) AS m, count(*)::DOUBLE AS t
  FROM dm a JOIN dm b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2
), fx AS (
  SELECT count(*) FILTER (WHERE sym_i = sym_j)::DOUBLE AS n, max(t) AS t, sum(s) FILTER (WHERE sym_i = sym_j) AS tr,
    sum(CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END * s * s) AS sq, sum(CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END * m) AS fo FROM emp
)"""


def ewma(lam: float, source: str = "ret", name: str = "cov") -> str:
    return f""", aged AS (SELECT date, {lam} ** (row_number() OVER (ORDER BY date DESC) - 1) AS wt FROM (SELECT DISTINCT date FROM {source})
), {name} AS (
  SELECT a.symbol AS sym_i, b.symbol AS sym_j, sum(wt * a.r * b.r) / sum(wt) AS cov
  FROM {source} a JOIN {source} b ON a.date = b.date AND a.symbol <= b.symbol JOIN aged ON aged.date = a.date GROUP BY 1, 2)"""


SIGMA = """, num AS (SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS i FROM ser
), seed AS (SELECT avg(r * r) AS s FROM num WHERE i < 30
), run AS (SELECT *, sum(CASE WHEN i >= 30 THEN 0.06 * r * r * 0.94::DOUBLE ** (-(i - 30)) ELSE 0 END) OVER (ORDER BY i) AS acc FROM num
), nxt AS (SELECT *, CASE WHEN i >= 30 THEN sqrt(0.94::DOUBLE ** (i - 30) * (0.94 * s + acc)) END AS next_sigma FROM run, seed
), sig AS (SELECT *, CASE WHEN i = 30 THEN sqrt(s) WHEN i > 30 THEN lag(next_sigma) OVER (ORDER BY i) END AS sigma FROM nxt)"""


def rolled(method: str) -> str:
    past = f"OVER (ORDER BY date ROWS BETWEEN {q.ROLL} PRECEDING AND 1 PRECEDING)"
    if method == "filtered_historical":
        return SIGMA + f""", zs AS (SELECT date, r, sigma, r / sigma AS x FROM sig
), est AS (SELECT date, r AS realized, -quantile_cont(x, {1 - q.CONFIDENCE}) {past} * sigma AS var, count(x) {past} AS c FROM zs
), roll AS (SELECT date, var, realized, realized < -var AS breach FROM est WHERE c >= {q.ROLL} AND var IS NOT NULL)"""
    var = f"-quantile_cont(r, {1 - q.CONFIDENCE}) {past}" if method == "historical" else f"-(avg(r) {past} + ({_Z!r}::DOUBLE) * stddev_samp(r) {past})"
    return f""", est AS (SELECT date, r AS realized, {var} AS var, count(r) {past} AS c FROM ser
), roll AS (SELECT date, var, realized, realized < -var AS breach FROM est WHERE c >= {q.ROLL})"""


TRANS = """, lagged AS (SELECT breach::INTEGER AS b, lag(breach::INTEGER) OVER (ORDER BY date) AS a FROM roll
), tr AS (
  SELECT count(*) AS n, sum(b)::BIGINT AS breaches, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01,
    count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11 FROM lagged)"""


def xl(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE ({x}) * ln({y}) END)"


_P = f"({1 - q.CONFIDENCE!r}::DOUBLE)"
POF = f"-2 * (({xl('n - breaches', '1 - ' + _P)} + {xl('breaches', _P)}) - ({xl('n - breaches', '1 - breaches / n::DOUBLE')} + {xl('breaches', 'breaches / n::DOUBLE')}))"
_PI, _A, _B = "((n01 + n11) / (n00 + n01 + n10 + n11)::DOUBLE)", "coalesce(n01 / nullif(n00 + n01, 0)::DOUBLE, 0)", "coalesce(n11 / nullif(n10 + n11, 0)::DOUBLE, 0)"
IND = f"CASE WHEN n >= 3 AND breaches >= 2 THEN -2 * (({xl('n01 + n11', _PI)} + {xl('n00 + n10', '1 - ' + _PI)}) - ({xl('n00', '1 - ' + _A)} + {xl('n01', _A)} + {xl('n10', '1 - ' + _B)} + {xl('n11', _B)})) END"

FACTS = """, lines AS (
  SELECT p_brand AS symbol, date_trunc('quarter', l_shipdate)::DATE AS qs, sum(l_extendedprice * (1 - l_discount)) AS revenue,
    sum(l_quantity) AS shares_outstanding, sum(p_retailprice) AS assets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), wide AS (SELECT *, revenue * 0.1::DOUBLE AS net_income, revenue * 0.4::DOUBLE AS gross_profit, assets * 0.6::DOUBLE AS book_equity, shares_outstanding * 20.0::DOUBLE AS liabilities FROM lines
), tall AS (UNPIVOT wide ON book_equity, net_income, revenue, gross_profit, assets, liabilities, shares_outstanding INTO NAME field VALUE value
), facts AS (
  SELECT symbol, field, value * k AS value, (qs + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end,
    ((qs + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE + d)::DATE AS filed, CASE WHEN quarter(qs) = 4 THEN 'FY' ELSE 'Q' || quarter(qs) END AS fp,
    CASE d WHEN 45 THEN '10-Q' ELSE '10-Q/A' END AS form, year(qs)::INTEGER AS fy
  FROM tall, (VALUES (45, 1.0::DOUBLE), (120, 1.02::DOUBLE)) AS f(d, k)
), seen AS (SELECT * FROM facts WHERE field NOT IN ('net_income', 'revenue', 'gross_profit') OR fp = 'FY')"""
PIT = FACTS + f""", best AS (
  SELECT symbol, field, value FROM seen WHERE filed <= DATE '{q.AS_OF}' QUALIFY row_number() OVER (PARTITION BY symbol, field ORDER BY period_end DESC, filed DESC) = 1)"""
FIELDS = ("book_equity", "net_income", "revenue", "gross_profit", "assets", "liabilities", "shares_outstanding")
_B52 = q.BARS
CHAR = prices("p_brand") + FACTS + f""", ends AS (SELECT max(date) AS as_of FROM prices WHERE close IS NOT NULL GROUP BY date_trunc('week', date)
), mv AS (SELECT symbol, date, px, px / lag(px) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px
), feat AS (
  SELECT symbol, date, lag(px, {_B52['skip']}) OVER o / lag(px, {_B52['long']}) OVER o - 1 AS momentum,
    CASE WHEN count(r) OVER b >= {_B52['least']} THEN stddev_samp(r) OVER b END AS vol FROM mv
  WINDOW o AS (PARTITION BY symbol ORDER BY date), b AS (PARTITION BY symbol ORDER BY date ROWS {_B52['vol'] - 1} PRECEDING)
)"""


def characteristics() -> str:
    fields = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in FIELDS)
    return CHAR + f""", syms AS (SELECT DISTINCT symbol FROM prices), grid AS (SELECT as_of, symbol FROM ends, syms
), f1 AS (SELECT g.as_of, g.symbol, f.momentum, f.vol FROM grid g ASOF JOIN feat f ON g.symbol = f.symbol AND g.as_of >= f.date
), f2 AS (SELECT g.as_of, g.symbol, p.close FROM grid g ASOF JOIN prices p ON g.symbol = p.symbol AND g.as_of >= p.date
), pit AS (
  SELECT as_of, s.symbol, field, value FROM ends JOIN seen s ON filed <= as_of
  QUALIFY row_number() OVER (PARTITION BY as_of, s.symbol, field ORDER BY period_end DESC, filed DESC) = 1
), fund AS (SELECT as_of, symbol, {fields} FROM pit GROUP BY 1, 2
), joined AS (
  SELECT *, CASE WHEN close * shares_outstanding > 0 THEN close * shares_outstanding END AS mcap, CASE WHEN assets > 0 THEN assets END AS held
  FROM f1 LEFT JOIN f2 USING (as_of, symbol) LEFT JOIN fund USING (as_of, symbol)
), chars AS (
  SELECT as_of, symbol, book_equity / mcap AS bp, net_income / mcap AS ep, ln(mcap) AS log_mcap, gross_profit / held AS gp_assets,
    liabilities / held AS leverage, momentum, vol FROM joined)"""


def _z(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) OVER d = 0 THEN {x} * 0 ELSE ({x} - avg({x}) OVER d) / stddev_pop({x}) OVER d END"


def styles() -> str:
    clip = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, 0.01) OVER d), quantile_cont({c}, 0.99) OVER d) END AS {c}" for c in RAW)
    score = ", ".join(f"{_z(c)} AS {c}" for c in RAW)
    mean = lambda a, b: f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif(({a} IS NOT NULL)::INTEGER + ({b} IS NOT NULL)::INTEGER, 0)"
    return characteristics() + f""", clipped AS (SELECT as_of, symbol, {clip} FROM chars WINDOW d AS (PARTITION BY as_of)
), zed AS (SELECT as_of, symbol, {score} FROM clipped WINDOW d AS (PARTITION BY as_of)
), comp AS (SELECT *, {mean('bp', 'ep')} AS v, {mean('gp_assets', '(-leverage)')} AS k FROM zed
), styled AS (SELECT as_of, symbol, {_z('v')} AS value, momentum, log_mcap AS size, {_z('k')} AS quality, -vol AS low_vol FROM comp WINDOW d AS (PARTITION BY as_of))"""


def neutral() -> str:
    cols = ", ".join(f"CASE WHEN sector IS NULL THEN {c} ELSE {c} - avg({c}) OVER (PARTITION BY as_of, sector) END AS {c}" for c in STYLES)
    return styles() + f""", sect AS (SELECT DISTINCT p_brand AS symbol, substr(p_brand, 7, 1) AS sector FROM part WHERE substr(p_brand, 7, 1) <> '5'
), neut AS (SELECT as_of, s.symbol, {cols} FROM styled s LEFT JOIN sect USING (symbol))"""


LAST = styles() + ", lastx AS (SELECT * FROM styled WHERE as_of = (SELECT max(as_of) FROM styled))"
_NAMES = "['market', 'value', 'momentum', 'size', 'quality', 'low_vol']"
OWN = f", own AS (SELECT date, ({_NAMES})[least(dense_rank() OVER (ORDER BY symbol), 6)] AS factor, r AS value FROM ret)"
PUB = """, pub AS (
  SELECT date, max(r) FILTER (WHERE k = 2) AS hml, max(r) FILTER (WHERE k = 1) AS mkt_rf, max(r) FILTER (WHERE k = 3) AS mom, max(r) FILTER (WHERE k = 4) AS smb
  FROM (SELECT *, dense_rank() OVER (ORDER BY symbol) AS k FROM ret) GROUP BY date)"""


def compounded(edges: str) -> str:
    cols = ", ".join(f"coalesce(product(1 + {c}), 1) - 1 AS {c}" for c in ("hml", "mkt_rf", "mom", "smb"))
    return f""", spans AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nxt FROM (SELECT DISTINCT as_of FROM {edges})
), comp AS (SELECT as_of, {cols} FROM spans JOIN pub ON date > as_of AND date <= nxt GROUP BY as_of)"""


WALK = f""", days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ret)
), seg AS (SELECT ret.*, i, (i - {q.WINDOW}) // {q.STEP} AS k FROM ret JOIN days USING (date) WHERE i >= {q.WINDOW}
), val AS (SELECT symbol, date, i, k, weight * product(1 + r) OVER (PARTITION BY symbol, k ORDER BY i) AS v FROM seg JOIN eq USING (symbol)
), tot AS (SELECT date, i, k, sum(v) AS v FROM val GROUP BY ALL
), gross AS (SELECT date, i, k, v / coalesce(lag(v) OVER (PARTITION BY k ORDER BY i), 1) - 1 AS gross, row_number() OVER (PARTITION BY k ORDER BY i) = 1 AS first_ FROM tot
), drift AS (SELECT k + 1 AS k, symbol, v / sum(v) OVER (PARTITION BY k, i) AS had FROM val QUALIFY i = max(i) OVER (PARTITION BY k)
), trade AS (SELECT s.k, sum(abs(eq.weight - coalesce(had, 0))) AS traded FROM (SELECT DISTINCT k FROM seg) s CROSS JOIN eq LEFT JOIN drift ON drift.k = s.k AND drift.symbol = eq.symbol GROUP BY s.k
), bt AS (SELECT 'equal_weight' AS strategy, date, i, gross, gross - CASE WHEN first_ THEN traded * {q.COST}::DOUBLE / 10000 ELSE 0 END AS net FROM gross JOIN trade USING (k))"""

SCORED = """, sc AS (SELECT symbol, (i * 7) % 5 + i / 10.0::DOUBLE AS score FROM names WHERE i > 1
), zs AS (SELECT symbol, (score - avg(score) OVER ()) / nullif(stddev_pop(score) OVER (), 0) AS z FROM sc)"""
TRADES = f""", cur AS (SELECT * FROM w WHERE weight < 0.25
), bothw AS (SELECT symbol, coalesce(cur.weight, 0) AS before, coalesce(eq.weight, 0) AS target FROM cur FULL JOIN eq USING (symbol)
), dr AS (SELECT *, target - before AS drift, (target - before) * {q.NAV}::DOUBLE AS dollars FROM bothw WHERE abs(target - before) >= 1e-9
), plan AS (
  SELECT *, CASE WHEN skip THEN 'skip' ELSE 'trade' END AS action, CASE WHEN skip THEN 0 ELSE abs(dollars) * 10.0::DOUBLE / 10000 END AS cost, CASE WHEN skip THEN before ELSE target END AS after
  FROM (SELECT *, abs(drift) <= 0.03 OR abs(dollars) < 0 AS skip FROM dr))"""


def _risk() -> str:
    b = " UNION ALL ".join(["SELECT symbol, 'market' AS factor, 1.0::DOUBLE AS b FROM lastx", *[f"SELECT symbol, '{s}', {s} FROM lastx" for s in STYLES]])
    brand = rets("p_brand")[len(prices("p_brand")) :]
    return f"""{LAST}{brand}{book()}, {apart(rets())}, fac AS (SELECT date, ({_NAMES})[least(dense_rank() OVER (ORDER BY symbol), 6)] AS symbol, r FROM t_ret)
{ewma(0.97, "fac", "fcov")}, ff AS (SELECT * FROM fcov UNION ALL SELECT sym_j, sym_i, cov FROM fcov WHERE sym_i < sym_j
), spec AS (SELECT symbol, var_samp(r) AS specific FROM ret GROUP BY 1
), bl AS ({b}), x AS (SELECT factor, sum(weight * b) AS x FROM bl JOIN w USING (symbol) GROUP BY 1
), fxx AS (SELECT sym_i AS factor, sum(cov * x) AS fx FROM ff JOIN x ON sym_j = factor GROUP BY 1
), fp AS (SELECT factor, x, x * fx AS part FROM x JOIN fxx USING (factor)
), pos AS (
  SELECT symbol, weight, weight * (common + weight * specific) AS part, weight * weight * specific AS own
  FROM w JOIN spec USING (symbol) JOIN (SELECT symbol, sum(b * fx) AS common FROM bl JOIN fxx USING (factor) GROUP BY 1) USING (symbol)
), tt AS (SELECT (SELECT sum(part) FROM fp) AS fv, (SELECT sum(own) FROM pos) AS sv)"""


def eliminated(systems: str, by: str = "") -> str:
    """sol (by, i, x): linear systems (by, i, a row's coefficients and right side as a list) solved by Gauss-Jordan, a pivot a round."""
    key, own = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f""", gauss AS (
  SELECT {key}0 AS k, list(a ORDER BY i) AS m FROM {systems} {own}
  UNION ALL SELECT {key}k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gauss WHERE k < len(m)
), sol AS (SELECT {key}unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda r: r[-1])) AS x FROM gauss WHERE k = len(m))"""


#: Least variance with weights from 0 to a half: each way to hold symbols free (0), at 0 (1) or at a half (2) is a linear system; the best solution within the bounds.
CORNERS = """, ways AS (SELECT unnest(range(0, (3 ** (SELECT count(*) FROM nm))::BIGINT)) AS s
), st AS (SELECT s, i, symbol, (s // (3 ** (i - 1))::BIGINT) % 3 AS d FROM ways, nm QUALIFY min(d) OVER (PARTITION BY s) = 0
), sy AS (
  SELECT s, st.i, list_concat(list(CASE WHEN d = 0 THEN cov * 10000 WHEN nm.i = st.i THEN 1 ELSE 0 END::DOUBLE ORDER BY nm.i), [CASE WHEN d = 0 THEN -1 ELSE 0 END::DOUBLE, CASE WHEN d = 2 THEN 0.5 ELSE 0 END::DOUBLE]) AS a
  FROM st JOIN whole ON sym_i = st.symbol JOIN nm ON nm.symbol = sym_j GROUP BY s, st.i, d
  UNION ALL SELECT s, count(*) + 1, list_concat(list(1.0::DOUBLE), [0.0::DOUBLE, 1.0::DOUBLE]) FROM st GROUP BY s
)""" + eliminated("sy", "s") + """, risk AS (
  SELECT a.s, sum(a.x * b.x * cov) AS v FROM sol a JOIN nm p ON p.i = a.i JOIN sol b ON b.s = a.s JOIN nm q ON q.i = b.i JOIN whole ON sym_i = p.symbol AND sym_j = q.symbol
  GROUP BY a.s HAVING min(a.x) >= -1e-12 AND max(a.x) <= 0.5 + 1e-12)"""
#: Equal shares of variance: w -> sqrt(w / (S w)) until it stands still.
PARITY = """, mat AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, list(cov ORDER BY sym_j) AS a FROM whole JOIN nm ON symbol = sym_i GROUP BY i)
), parity AS (
  SELECT 0 AS t, list(1.0::DOUBLE) AS w FROM nm
  UNION ALL SELECT t + 1, list_transform(w, lambda x, i: sqrt(x / list_inner_product(m[i], w))) FROM parity, mat WHERE t < 200)"""
PANEL = styles() + """, wk AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nxt FROM ends
), mvs AS (SELECT wk.as_of, a.symbol, b.px / a.px - 1 AS r FROM wk JOIN px a ON a.date = wk.as_of JOIN px b ON b.date = wk.nxt AND a.symbol = b.symbol
), obs AS (SELECT s.as_of, s.symbol, r, [1.0::DOUBLE, value, momentum, size, quality, low_vol] AS v FROM styled s JOIN mvs USING (as_of, symbol)
  WHERE value + momentum + size + quality + low_vol + r IS NOT NULL
), fat AS (SELECT as_of FROM obs GROUP BY 1 HAVING count(*) >= 8
), cell AS (SELECT as_of, i, j, sum(v[i] * v[j]) AS c FROM obs, range(1, 7) AS f(i), range(1, 7) AS g(j) WHERE as_of IN (SELECT as_of FROM fat) GROUP BY ALL
), rhs AS (SELECT as_of, i, sum(v[i] * r) AS c FROM obs, range(1, 7) AS f(i) GROUP BY ALL
), sy AS (SELECT as_of, i, list_append(list(c.c ORDER BY j), any_value(rhs.c)) AS a FROM cell c JOIN rhs USING (as_of, i) GROUP BY ALL)""" + eliminated("sy", "as_of")
RESIDUAL = """, res AS (
  SELECT obs.as_of, symbol, r, r - list_inner_product(v, co) AS e FROM obs JOIN (SELECT as_of, list(x ORDER BY i) AS co FROM sol GROUP BY 1) USING (as_of))"""
FILED = "SELECT upper(symbol) AS symbol, field, round(value, 7) + 0.0 AS value, period_end, filed, form, fy AS fiscal_year, fp AS fiscal_period FROM facts"
ASKED = "('BRAND#4', 'BRAND#11', 'BRAND#7')"


def chi_tail(x: str) -> str:
    """The probability that a chi-square of one degree exceeds x: 1 - erf(sqrt(x / 2)) by its series of positive terms."""
    z = f"sqrt(greatest({x}, 0) / 2)"
    return f"1 - exp(-greatest({x}, 0) / 2) * list_sum(list_transform(range(0, 120), lambda m: {z} ** (2 * m + 1) / gamma(m + 1.5::DOUBLE)))"


#: The probability of as many breaches or fewer.
BINOMIAL = f"list_sum(list_transform(range(0, breaches + 1), lambda b: exp(lgamma(n + 1) - lgamma(b + 1) - lgamma(n - b + 1) + b * ln({_P}) + (n - b) * ln(1 - {_P}))))"
WINDOWS = f""", days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ret)
), ks AS (SELECT unnest(range(0, (SELECT (max(i) - {q.WINDOW}) // {q.STEP} + 1 FROM days))) AS k)"""
TRAILING = WINDOWS + f""", win AS (
  SELECT k, symbol, var_samp(r) AS v, count(*) AS c FROM ks JOIN days ON i >= k * {q.STEP} AND i < k * {q.STEP} + {q.WINDOW} JOIN ret USING (date) GROUP BY 1, 2
), tg AS (
  SELECT 'inverse_variance' AS strategy, k, symbol, 1 / v / sum(1 / v) OVER (PARTITION BY k) AS weight, c FROM win
  UNION ALL SELECT 'inverse_volatility', k, symbol, 1 / sqrt(v) / sum(1 / sqrt(v)) OVER (PARTITION BY k), c FROM win)"""


PATHS = f""", seg AS (SELECT ret.*, i, (i - {q.WINDOW}) // {q.STEP} AS k FROM ret JOIN days USING (date) WHERE i >= {q.WINDOW}
), val AS (SELECT strategy, symbol, date, i, k, weight * product(1 + r) OVER (PARTITION BY strategy, symbol, k ORDER BY i) AS v FROM seg JOIN tg USING (symbol, k)
), gross AS (
  SELECT strategy, date, i, k, v / coalesce(lag(v) OVER s, 1) - 1 AS gross, row_number() OVER s = 1 AS first_
  FROM (SELECT strategy, date, i, k, sum(v) AS v FROM val GROUP BY ALL) WINDOW s AS (PARTITION BY strategy, k ORDER BY i)
), drift AS (SELECT strategy, k + 1 AS k, symbol, v / sum(v) OVER (PARTITION BY strategy, i) AS had FROM val QUALIFY i = max(i) OVER (PARTITION BY strategy, k)
), trade AS (SELECT strategy, k, sum(abs(weight - coalesce(had, 0))) AS traded FROM tg LEFT JOIN drift USING (strategy, k, symbol) GROUP BY ALL
), bt AS (SELECT strategy, date, gross, gross - CASE WHEN first_ THEN traded * {q.COST}::DOUBLE / 10000 ELSE 0 END AS r FROM gross JOIN trade USING (strategy, k)
), grown AS (SELECT *, product(1 + r) OVER (PARTITION BY strategy ORDER BY date) AS equity FROM bt
), eqty AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY date) AS peak FROM grown
), done AS (SELECT strategy, {SUMMARY}, product(1 + gross) ** (252.0::DOUBLE / count(*)) - 1 AS gross_cagr, bool_or(gross <= -1) AS wiped_out FROM eqty GROUP BY strategy
), turned AS (SELECT strategy, avg(traded / 2) AS avg_turnover, count(*) AS n_rebalances FROM trade GROUP BY strategy)"""


def leading(source: str, name: str) -> str:
    """lead: the largest eigenvalue of each symmetric matrix m of source (strategy, wk, m), by squaring it 40 times."""
    return f""", {name}_pw AS (
  SELECT strategy, wk, 0 AS t, m AS p FROM {source}
  UNION ALL SELECT strategy, wk, t + 1, list_transform(q, lambda r: list_transform(r, lambda x: CASE WHEN size > 0 THEN x / size ELSE 0 END)) FROM (
    SELECT *, list_sum(list_transform(q, lambda r, i: r[i])) AS size FROM (
      SELECT strategy, wk, t, list_transform(p, lambda r: list_transform(p, lambda c: list_inner_product(r, c))) AS q FROM {name}_pw WHERE t < 40))
), {name} AS (
  SELECT strategy, wk, m, list_sum(list_transform(m, lambda r, i: list_inner_product(r, p[i]))) / nullif(list_sum(list_transform(p, lambda r, i: r[i])), 0) AS lead
  FROM {name}_pw JOIN {source} USING (strategy, wk) WHERE t = 40)"""


def estimator_race(lw: str, oas: str) -> str:
    """Least-variance books on four estimates of each trailing window, and 1/N; cond: their mean condition numbers."""
    shrunk = lambda name, k: f"SELECT '{name}', wk, sym_i, sym_j, (1 - coalesce({k}, 0)) * s + coalesce({k}, 0) * CASE WHEN sym_i = sym_j THEN tr / n ELSE 0 END FROM cells JOIN fx USING (wk)"
    return rets() + WINDOWS + f""", nm AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM ret)
), wr AS (
  SELECT k AS wk, symbol, date, r, r - avg(r) OVER (PARTITION BY k, symbol) AS d, 0.94::DOUBLE ** (k * {q.STEP} + {q.WINDOW - 1} - i) AS wt
  FROM ks JOIN days ON i >= k * {q.STEP} AND i < k * {q.STEP} + {q.WINDOW} JOIN ret USING (date)
), cells AS (
  SELECT wk, a.symbol AS sym_i, b.symbol AS sym_j, avg(a.d * b.d) AS s, avg(a.d * a.d * b.d * b.d) AS m, covar_samp(a.r, b.r) AS sample, sum(a.wt * a.r * b.r) / sum(a.wt) AS ewma
  FROM wr a JOIN wr b USING (wk, date) GROUP BY ALL
), fx AS (SELECT wk, count(*) FILTER (WHERE sym_i = sym_j)::DOUBLE AS n, {q.WINDOW}::DOUBLE AS t, sum(s) FILTER (WHERE sym_i = sym_j) AS tr, sum(s * s) AS sq, sum(m) AS fo FROM cells GROUP BY wk
), est AS (
  SELECT 'sample' AS strategy, wk, sym_i, sym_j, sample AS c FROM cells UNION ALL SELECT 'ewma', wk, sym_i, sym_j, ewma FROM cells
  UNION ALL {shrunk('ledoit_wolf', lw)} UNION ALL {shrunk('oas', oas)}
), rw AS (SELECT strategy, wk, i, list(c ORDER BY sym_j) AS a FROM est JOIN nm ON symbol = sym_i GROUP BY ALL
), sy AS (SELECT strategy, wk, i, list_append(a, 1.0::DOUBLE) AS a FROM rw){eliminated("sy", "strategy, wk")}, tg AS (
  SELECT strategy, wk AS k, symbol, x / sum(x) OVER (PARTITION BY strategy, wk) AS weight FROM sol JOIN nm USING (i)
  UNION ALL SELECT 'equal_weight', k, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY k) FROM ks, nm
){PATHS}, mats AS (SELECT strategy, wk, list(a ORDER BY i) AS m FROM rw GROUP BY ALL){leading("mats", "top")}, rest AS (
  SELECT strategy, wk, list_transform(m, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = j THEN lead - x ELSE -x END)) AS m FROM top
){leading("rest", "low")}, cond AS (SELECT strategy, avg(top.lead / greatest(top.lead - coalesce(low.lead, 0), 1e-18)) AS avg_condition FROM top JOIN low USING (strategy, wk) GROUP BY strategy)"""


#: The recursion of variances written out: each day's by all days before it.
QUICK = """, num AS (SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS i FROM ser
), seed AS (SELECT avg(r * r) AS s FROM num WHERE i < 30
), nx AS (
  SELECT a.date, a.i, sqrt(0.6::DOUBLE ** (a.i - 29) * any_value(s) + sum(0.4 * b.r * b.r * 0.6::DOUBLE ** (a.i - b.i))) AS next_sigma
  FROM num a JOIN num b ON b.i <= a.i AND b.i >= 30, seed WHERE a.i >= 30 GROUP BY a.date, a.i)"""


def _spread(x: str) -> str:
    """Variance of the cluster x (places of symbols) under inverse-variance weights; m: the matrix."""
    cells = f"list_transform({x}, lambda a: list_sum(list_transform({x}, lambda b: m[a][b] / (m[a][a] * m[b][b]))))"
    return f"(list_sum({cells}) / list_sum(list_transform({x}, lambda a: 1 / m[a][a])) ** 2)"


#: Clusters are merged nearest first (older one to the left), the leaves halved, and each half weighted by the other's variance.
_NEAR = "list_min(flatten(list_transform(c[p].x, lambda a: list_transform(c[q].x, lambda b: 1 - m[a][b] / sqrt(m[a][a] * m[b][b])))))"
_HALF = "len(x) // 2"
HALVED = f""", mat AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, list(cov ORDER BY sym_j) AS a FROM whole JOIN nm ON symbol = sym_i GROUP BY i)
), tree AS (
  SELECT (SELECT count(*) FROM nm) AS made, (SELECT list({{'id': i, 'x': [i]}} ORDER BY i) FROM nm) AS c
  UNION ALL SELECT made + 1, list_append(list_filter(c, lambda e, i: i <> near.p AND i <> near.q), {{'id': made + 1, 'x': CASE WHEN c[near.p].id < c[near.q].id THEN c[near.p].x || c[near.q].x ELSE c[near.q].x || c[near.p].x END}})
  FROM (SELECT *, list_min(flatten(list_transform(range(1, len(c)), lambda p: list_transform(range(p + 1, len(c) + 1), lambda q: {{'d': {_NEAR}, 'p': p, 'q': q}})))) AS near FROM tree, mat WHERE len(c) > 1)
), halved AS (
  SELECT c[1].x AS x, 1.0::DOUBLE AS weight FROM tree WHERE len(c) = 1
  UNION ALL SELECT CASE h WHEN 0 THEN x[:{_HALF}] ELSE x[{_HALF} + 1:] END, weight * CASE h WHEN 0 THEN vr ELSE vl END / (vl + vr)
  FROM (SELECT x, weight, {_spread(f"x[:{_HALF}]")} AS vl, {_spread(f"x[{_HALF} + 1:]")} AS vr FROM halved, mat WHERE len(x) > 1), (VALUES (0), (1)) AS t(h))"""


def oracle_sql() -> dict[str, str]:
    half = prices("p_brand") + """, a AS (SELECT symbol, date, close, adj_close FROM prices WHERE date < DATE '1999-01-01'
), b AS (SELECT symbol, date, close * 1.1::DOUBLE AS close, adj_close * 1.1::DOUBLE AS adj_close FROM prices WHERE date >= DATE '1998-01-01')"""
    px = {"symbol!": None, "date!": None, "close": None, "adj_close": None}
    cov = {"sym_i!": None, "sym_j!": None, "cov": None}
    var = {"method!": None, "confidence": None, "horizon!": None, "var": None, "es": None}
    one = lambda m, h, v, e, source: f"(SELECT '{m}' AS method, {q.CONFIDENCE}::DOUBLE AS confidence, {h} AS horizon, {v} AS var, {e} AS es FROM {source})"
    tail = lambda col, source: f", qq AS (SELECT quantile_cont({col}, {1 - q.CONFIDENCE}) AS q FROM {source}), tl AS (SELECT avg({col}) AS t FROM {source}, qq WHERE {col} <= q)"
    roll = {"date!": None, "var": None, "realized": None, "breach!": None}
    walked = {"strategy!": None, "n!": None, "ann_return": "cagr", "vol": None, "sharpe": None, "max_drawdown": None, "avg_turnover": None, "cost_drag": "gross_cagr - cagr", "n_rebalances!": None, "wiped_out!": None}
    counts = {f"{c}!": None for c in ("n", "breaches", "n00", "n01", "n10", "n11")}
    style = {"as_of!": None, "symbol!": None, **dict.fromkeys(STYLES)}
    moments = ", mo AS (SELECT count(r)::DOUBLE AS n, avg(r) AS mu, stddev_samp(r) AS sd, skewness(r) AS skew, kurtosis(r) AS kurt FROM ser)"
    z = f"({_Z!r}::DOUBLE)"
    cf = lambda z: f"({z} + ({z}**2 - 1) * skew / 6 + ({z}**3 - 3 * {z}) * kurt / 24 - (2 * {z}**3 - 5 * {z}) * skew * skew / 36)"
    fhs = DAY + SIGMA + ", z AS (SELECT r / sigma AS z FROM sig WHERE i >= 30), nx AS (SELECT next_sigma AS nx FROM sig ORDER BY i DESC LIMIT 1)" + tail("z", "z")
    lw = "least((fo - sq) / (n * t), sq / n - (tr / n) ** 2) / nullif(sq / n - (tr / n) ** 2, 0)"
    oas = "CASE WHEN (t + 1 - 2 / n) * (sq - tr * tr / n) <= 0 THEN 1 ELSE least(((1 - 2 / n) * sq + tr * tr) / ((t + 1 - 2 / n) * (sq - tr * tr / n)), 1) END"
    shrunk = lambda k: f"(SELECT sym_i, sym_j, (1 - coalesce({k}, 0)) * s + coalesce({k}, 0) * CASE WHEN sym_i = sym_j THEN tr / n ELSE 0 END AS cov FROM (SELECT emp.sym_i, emp.sym_j, emp.s, fx.* FROM emp, fx))"
    shrunk_whole = rets() + SHRINK + f", lwc AS {shrunk(lw)}, whole AS (SELECT * FROM lwc UNION ALL SELECT sym_j, sym_i, cov FROM lwc WHERE sym_i < sym_j), nm AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM ret))"
    sized = prices() + """, names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS ord FROM (SELECT DISTINCT symbol FROM prices)
), pos AS (SELECT symbol, ord::INTEGER AS ord, CASE WHEN ord % 2 = 1 THEN ord * 10.0::DOUBLE END AS shares, CASE WHEN ord % 2 = 0 THEN 0.1::DOUBLE END AS weight FROM names
), lp AS (SELECT symbol, arg_max(close, date) AS close FROM prices GROUP BY 1
), sz AS (SELECT pos.*, shares * close AS dollars, coalesce(sum(shares * close) OVER (), 0) + 50000.0::DOUBLE AS d, coalesce(sum(weight) OVER (), 0) AS w FROM pos LEFT JOIN lp USING (symbol)
), nv AS (SELECT *, d / (1 - w) AS nav FROM sz)"""
    check = f"{rets('p_type', 'day')}{PUB}, {apart(rets())}, own AS (SELECT date AS as_of, ({_NAMES})[least(dense_rank() OVER (ORDER BY symbol), 6)] AS factor, r AS value FROM t_ret){compounded('own')}"
    check += """, cc AS (
  SELECT factor, series, sign, corr(value, there) AS c, count(*) AS periods FROM own JOIN (
    SELECT as_of, 'market' AS factor, 'mkt_rf' AS series, 1 AS sign, mkt_rf AS there FROM comp UNION ALL SELECT as_of, 'value', 'hml', 1, hml FROM comp
    UNION ALL SELECT as_of, 'size', 'smb', -1, smb FROM comp UNION ALL SELECT as_of, 'momentum', 'mom', 1, mom FROM comp) USING (as_of, factor)
  WHERE there IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3)"""
    ends = ", ends AS (SELECT max(date) AS as_of FROM prices GROUP BY date_trunc('week', date))"
    return {
        "portfolio_stats": final(WEEK + series("eq", "bench") + EQUITY, {"n!": None, "cagr": None, "vol": None, "sharpe": None, "max_drawdown": None, "beta": None}, f"(SELECT {SUMMARY} FROM eqty), (SELECT covar_samp(s.r, b.r) / nullif(var_samp(b.r), 0) AS beta FROM ser s JOIN bench b USING (date))"),
        "latest_prices": final(prices("p_brand"), {"symbol!": None, "date!": "max(date)", "close": "arg_max(close, date)"}, "prices", 4, f"WHERE date <= DATE '{q.AS_OF}' GROUP BY symbol"),
        "list_symbols": f"WITH {prices('p_brand')} SELECT DISTINCT symbol FROM prices ORDER BY symbol",
        "prices_adjusted": final(prices("p_brand"), {"symbol!": None, "date!": None, "px": None}, "px", 4, f"WHERE date BETWEEN DATE '1996-01-01' AND DATE '{q.AS_OF}'"),
        "prices_normalized": final("e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id DESC) = 1)", {"symbol!": "'EVT'", "date!": "ts::DATE", "open": "NULL", "high": "value * 1.01::DOUBLE", "close": "value", "adj_close": "value"}, "e", 6),
        "prices_upsert": final(half, px, "(SELECT * FROM a ANTI JOIN b USING (symbol, date) UNION ALL SELECT * FROM b)", 4),
        "prices_import_ignore": final(half, px, "(SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (symbol, date))", 4),
        "prices_selected": final(prices("p_brand"), {"symbol!": "upper(symbol)", "date!": None, "px": "close"}, "prices", 4, f"WHERE upper(symbol) IN {ASKED} AND date BETWEEN DATE '1996-01-01' AND DATE '{q.AS_OF}'"),
        "store_ingested": final(
            prices("p_brand") + f""", up AS (SELECT * REPLACE (upper(symbol) AS symbol) FROM prices
), own AS (SELECT symbol, date, close, close AS adj_close FROM up WHERE symbol IN {ASKED} AND date >= DATE '1996-01-01'
), new AS (SELECT symbol, date, close * 2 AS close, adj_close * 2 AS adj_close FROM up ANTI JOIN own USING (symbol, date) WHERE date < DATE '1997-01-01'
), cnt AS (SELECT symbol, count(*) AS brought FROM own GROUP BY 1)""",
            {"symbol!": None, "date!": None, "close": None, "adj_close": None, "brought!": "coalesce(brought, 0)", "added!": "(SELECT count(*) FROM new)"}, "(SELECT * FROM own UNION ALL SELECT * FROM new) LEFT JOIN cnt USING (symbol)", 4,
        ),
        "scores_loaded": final(prices("p_brand") + book("prices") + SCORED, {"symbol!": "upper(symbol)", "score": None}, "sc"),
        "filings_extracted": f"WITH {FACTS.removeprefix(', ')}\n{FILED}",
        "filings_ingested": f"WITH {FACTS.removeprefix(', ')}, got AS ({FILED})\nSELECT * REPLACE (CASE WHEN filed < DATE '1998-01-01' THEN 1.0::DOUBLE ELSE value END AS value) FROM got WHERE filed < DATE '1998-01-01' OR symbol IN {ASKED}",
        "returns_aligned": final(rets("p_brand"), {"symbol!": None, "date!": None, "r": None}, "ret"),
        "blended_returns": final(WEEK, {"date!": None, "r": None}, "ser"),
        "equity_drawdown": final(WEEK + EQUITY, {"date!": None, "equity": None, "peak": None, "drawdown": "equity / peak - 1"}, "eqty"),
        "beta": final(rets("p_brand") + book() + series("eq"), {"symbol!": None, "beta": "covar_samp(ret.r, ser.r) / nullif(var_samp(ser.r), 0)"}, "ret JOIN ser USING (date)", 6, "GROUP BY symbol"),
        "cov_sample": final(rets() + COV, cov, "cov", 10),
        "cov_ewma": final(rets() + ewma(0.94), cov, "cov", 10),
        "cov_ledoit_wolf": final(rets() + SHRINK, cov, shrunk(lw), 10),
        "cov_oas": final(rets() + SHRINK, cov, shrunk(oas), 10),
        "cov_annualized": final(rets() + COV, {**cov, "cov": "cov * 52"}, "cov"),
        "resolve_weights": final(sized, {"symbol!": None, "weight": "coalesce(weight, dollars / nav)", "cash_weight": "50000.0::DOUBLE / nav", "nav": None, "ord!": None}, "nv", 6),
        "var_parametric": final(DAY, var, one("parametric", 10, f"-(avg(r) * 10 + {z} * stddev_samp(r) * sqrt(10))", f"stddev_samp(r) * sqrt(10) * {_PDF!r}::DOUBLE / {1 - q.CONFIDENCE!r}::DOUBLE - avg(r) * 10", "ser")),
        "var_cornish_fisher": final(DAY + moments, var, one("cornish_fisher", 1, f"-(mu + {cf(z)} * sd)", f"-(mu + sd * (SELECT avg({cf('t')}) FROM unnest({_TAIL}) AS u(t)))", "mo")),
        "min_variance": final(shrunk_whole + ", sy AS (SELECT i, list_append(list(cov ORDER BY sym_j), 1.0::DOUBLE) AS a FROM whole JOIN nm ON symbol = sym_i GROUP BY i)" + eliminated("sy"), {"symbol!": None, "weight": "x / (SELECT sum(x) FROM sol)"}, "sol JOIN nm USING (i)", 6).replace("WITH ", "WITH RECURSIVE ", 1),
        "mvo": final(shrunk_whole + CORNERS, {"symbol!": None, "weight": "x"}, "sol JOIN nm USING (i)", 6, "WHERE s = (SELECT arg_min(s, v) FROM risk)").replace("WITH ", "WITH RECURSIVE ", 1),
        "hrp": final(shrunk_whole + HALVED, {"symbol!": None, "weight": None}, "halved JOIN nm ON i = x[1]", 6, "WHERE len(x) = 1").replace("WITH ", "WITH RECURSIVE ", 1),
        "risk_parity": final(shrunk_whole + PARITY, {"symbol!": None, "weight": "w[i] / list_sum(w)"}, "parity, nm", 6, "WHERE t = 200").replace("WITH ", "WITH RECURSIVE ", 1),
        "black_litterman": final(
            rets() + book() + COV + IMPLIED + SCORED + """, vw AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i, implied + 0.05 * sqrt(52 * cov) * z - implied AS gap FROM zs JOIN implied USING (symbol) JOIN cov ON sym_i = symbol AND sym_j = symbol
), sy AS (SELECT a.i, list_append(list(0.05 * cov * CASE WHEN a.i = b.i THEN 1 / 0.3::DOUBLE ELSE 1 END ORDER BY b.i), any_value(a.gap)) AS a FROM vw a, vw b JOIN fullcov ON sym_j = b.symbol WHERE sym_i = a.symbol GROUP BY a.i)""" + eliminated("sy"),
            {"symbol!": None, "prior": "any_value(implied)", "posterior": "any_value(implied) + sum(0.05 * cov * x)"}, "implied JOIN fullcov ON sym_i = symbol JOIN vw ON vw.symbol = sym_j JOIN sol USING (i)", 8, "GROUP BY implied.symbol",
        ).replace("SELECT symbol AS symbol, round((any_value", "SELECT implied.symbol AS symbol, round((any_value").replace("WITH ", "WITH RECURSIVE ", 1),
        "fit_panel": final(PANEL, {"as_of!": None, "factor!": f"({_NAMES})[i]", "value": "x"}, "sol", 6).replace("WITH ", "WITH RECURSIVE ", 1),
        "panel_factor_cov": final(PANEL + f", fr AS (SELECT as_of AS date, ({_NAMES})[i] AS symbol, x AS r FROM sol)" + ewma(0.97, "fr"), cov, "cov", 8).replace("WITH ", "WITH RECURSIVE ", 1),
        "panel_residuals": final(PANEL + RESIDUAL, {"as_of!": None, "symbol!": None, "value": "e"}, "res", 6).replace("WITH ", "WITH RECURSIVE ", 1),
        "panel_specific": final(PANEL + RESIDUAL, {"symbol!": None, "specific": "CASE WHEN count(*) >= 20 THEN var_samp(e) END"}, "res", 8, "GROUP BY symbol").replace("WITH ", "WITH RECURSIVE ", 1),
        "panel_fits": final(PANEL + RESIDUAL, {"as_of!": None, "r2": "1 - sum(e * e) / (var_pop(r) * count(*))", "n_obs": "count(*)"}, "res", 6, "GROUP BY as_of").replace("WITH ", "WITH RECURSIVE ", 1),
        "stress_scenario": final(
            prices() + f", moved_px AS (SELECT symbol, date + {q.SHIFT} AS date, px FROM px)" + book("px") + ", e AS (SELECT symbol, min(date) AS d0, max(date) AS d1, arg_min(px, date) AS p0, arg_max(px, date) AS p1 FROM moved_px WHERE date BETWEEN DATE '2008-09-01' AND DATE '2009-03-09' GROUP BY 1), rr AS (SELECT symbol, weight, CASE WHEN d0 - DATE '2008-09-01' <= 7 AND DATE '2009-03-09' - d1 <= 7 THEN p1 / p0 - 1 END AS ret FROM w LEFT JOIN e USING (symbol))",
            {"scenario!": "'gfc2008'", "symbol!": None, "weight": None, "ret": None, "contribution": "weight * ret"}, "rr",
        ),
        "return_moments": final(DAY + moments, dict.fromkeys(("n", "mu", "sd", "skew", "kurt")), "mo"),
        "var_historical": final(DAY + tail("r", "ser"), var, one("historical", 1, "-q", "-t", "qq, tl")),
        "var_fhs": final(fhs, var, one("filtered_historical", 1, "-q * nx", "-t * nx", "qq, tl, nx")),
        "rolling_var_hist": final(DAY + rolled("historical"), roll, "roll"),
        "rolling_var_param": final(DAY + rolled("parametric"), roll, "roll"),
        "rolling_var_fhs": final(DAY + rolled("filtered_historical"), roll, "roll"),
        "breach_transitions": final(DAY + rolled("historical") + TRANS, counts, "tr"),
        "coverage_tests": final(DAY + rolled("parametric") + TRANS, {**counts, "lr_pof": None, "lr_ind": None, "p_cc": "exp(-(lr_pof + lr_ind) / 2)"}, f"(SELECT *, {POF} AS lr_pof, {IND} AS lr_ind FROM tr)", 6),
        "worst_breach": final(DAY + rolled("parametric"), {"worst_ratio": "-realized / var", "worst_date!": "date", "worst_loss": "-realized", "worst_var": "var"}, "roll", 6, "WHERE breach ORDER BY -realized / var DESC LIMIT 1"),
        "validate_var": final(
            DAY + rolled("filtered_historical") + TRANS + ", wb AS (SELECT -realized / var AS worst_ratio, date AS worst_date, -realized AS worst_loss, var AS worst_var FROM roll WHERE breach ORDER BY 1 DESC LIMIT 1)",
            {**counts, "lr_pof": None, "lr_ind": None, "p_cc": "exp(-(lr_pof + lr_ind) / 2)", "p_pof": chi_tail("lr_pof"), "p_ind": f"CASE WHEN lr_ind IS NOT NULL THEN {chi_tail('lr_ind')} END", "zone!": f"CASE WHEN {BINOMIAL} < 0.95 THEN 'green' WHEN {BINOMIAL} < 0.9999 THEN 'yellow' ELSE 'red' END", "expected": f"n * {_P}", "worst_ratio": None, "worst_date!": None, "worst_loss": None, "worst_var": None},
            f"(SELECT *, {POF} AS lr_pof, {IND} AS lr_ind FROM tr) LEFT JOIN wb ON true", 9,
        ),
        "pit_fundamentals": final(PIT.removeprefix(", "), {"symbol!": None, **{f: f"max(value) FILTER (WHERE field = '{f}')" for f in FIELDS}}, "best", 2, "GROUP BY symbol"),
        "raw_characteristics": final(characteristics(), {"as_of!": None, "symbol!": None, **dict.fromkeys(RAW)}, "chars", 6),
        "clean_exposures": final(styles(), style, "styled", 5),
        "sector_neutral": final(neutral(), style, "neut", 5),
        "week_ends": f"WITH {prices('p_type', 'day')}{ends} SELECT as_of FROM ends",
        "period_compound": final(rets("p_type", "day") + PUB + ends + compounded("ends"), {"as_of!": None, **dict.fromkeys(("hml", "mkt_rf", "mom", "smb"))}, "comp"),
        "factor_crosscheck": final(check, {"factor!": None, "series!": None, "sign!": None, "correlation": "CASE WHEN periods >= 8 THEN c END", "periods!": None, "passed!": "coalesce(periods >= 8 AND c * sign >= 0.8, false)"}, "cc", 6),
        "factor_library": final(
            rets("p_type", "day") + PUB, {"date!": None, **{c: f"round({c} * 100, 4) / 100" for c in ("mkt_rf", "smb", "hml")}, "rf": "CASE WHEN day(date) <> 13 THEN 0.0001 END", "mom": "round(mom * 100, 4) / 100"},
            "pub", 8, "WHERE date >= DATE '1996-01-01' AND isodow(date) < 5",
        ),
        "trailing_targets": final(rets() + TRAILING, {"strategy!": None, "k!": "k::INTEGER", "symbol!": None, "weight": None, "note": "c", "error!": "NULL::VARCHAR"}, "tg"),
        "backtest_trailing": final(rets() + TRAILING + PATHS, walked, "done JOIN turned USING (strategy)", 6),
        "cov_race": final(
            estimator_race(lw, oas), {**walked, "avg_condition": None, "error!": "NULL::VARCHAR"}, "done JOIN turned USING (strategy) LEFT JOIN cond USING (strategy)", 6,
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "volatility": final(DAY + QUICK, {"date!": None, "sigma": "CASE WHEN i = 30 THEN sqrt((SELECT s FROM seed)) WHEN i > 30 THEN lag(next_sigma) OVER (ORDER BY i) END", "next_sigma": None}, "num LEFT JOIN nx USING (date, i)"),
        "backtest_equal_weight": final(rets() + book() + WALK, {"strategy!": None, "date!": None, "gross": None, "net": None}, "bt"),
        "backtest_summary": final(
            rets() + book() + WALK + ", ser AS (SELECT date, net AS r FROM bt)" + EQUITY,
            {"strategy!": "'equal_weight'", "n!": None, "ann_return": "cagr", "vol": None, "sharpe": None, "max_drawdown": None, "avg_turnover": None, "cost_drag": "gross_cagr - cagr", "n_rebalances!": None, "wiped_out!": None},
            f"(SELECT {SUMMARY} FROM eqty), (SELECT product(1 + gross) ** (252.0::DOUBLE / count(*)) - 1 AS gross_cagr, bool_or(gross <= -1) AS wiped_out FROM bt), (SELECT avg(traded / 2) AS avg_turnover, count(*) AS n_rebalances FROM trade)", 6,
        ),
        "implied_returns": final(rets() + book() + COV + IMPLIED, {"symbol!": None, "implied": None}, "implied"),
        "views_from_scores": final(rets() + book() + COV + IMPLIED + SCORED, {"symbol!": None, "value": "implied + 0.05 * sqrt(52 * cov) * z", "confidence": "0.3"}, "zs JOIN implied USING (symbol) JOIN cov ON sym_i = symbol AND sym_j = symbol"),
        "stress_replay": final(
            prices() + book("px") + f", e AS (SELECT symbol, min(date) AS d0, max(date) AS d1, arg_min(px, date) AS p0, arg_max(px, date) AS p1 FROM px WHERE date BETWEEN DATE '{q.CRISIS[0]}' AND DATE '{q.CRISIS[1]}' GROUP BY 1), rr AS (SELECT symbol, weight, CASE WHEN d0 - DATE '{q.CRISIS[0]}' <= 7 AND DATE '{q.CRISIS[1]}' - d1 <= 7 THEN p1 / p0 - 1 END AS ret FROM w LEFT JOIN e USING (symbol))",
            {"symbol!": None, "weight": None, "ret": None, "contribution": "weight * ret"}, "rr",
        ),
        "factor_shock": final(LAST + book("lastx") + ", s AS (SELECT sum(weight) AS m, sum(weight * value) AS v, sum(weight * momentum) AS o FROM lastx JOIN w USING (symbol)), t AS (SELECT 'market' AS factor, m AS exposure, -0.2::DOUBLE AS shock FROM s UNION ALL SELECT 'value', v, 0.05::DOUBLE FROM s UNION ALL SELECT 'momentum', o, -0.1::DOUBLE FROM s)", {"factor!": None, "exposure": None, "shock": None, "contribution": "exposure * shock"}, "t", 5),
        "rebalance_plan": final(rets() + book() + TRADES, {"symbol!": None, "before": None, "target": None, "drift": None, "dollars": None, "action!": None, "cost": None, "after": None}, "plan", 6),
        "rebalance_totals": final(rets() + book() + TRADES, {"traded": "coalesce(sum(abs(dollars)) FILTER (WHERE action = 'trade'), 0)", "cost": "sum(cost)", "n_trades!": "count(*) FILTER (WHERE action = 'trade')", "n_skipped!": "count(*) FILTER (WHERE action = 'skip')", "cash_after": "1 - (SELECT sum(weight) FROM cur) - sum(after - before)"}, "plan", 6),
        "decompose_totals": final(_risk(), {"total_vol": "sqrt((fv + sv) * 52)", "factor_vol": "sqrt(fv * 52)", "specific_vol": "sqrt(sv * 52)", "factor_share": "fv / (fv + sv)", "specific_share": "sv / (fv + sv)", "effective_bets": "(SELECT CASE WHEN min(part) >= 0 THEN (fv + sv) ** 2 / sum(part * part) END FROM pos)", "n_positions!": "(SELECT count(*) FROM pos)"}, "tt", 6),
        "decompose_factors": final(_risk(), {"factor!": None, "exposure": "x", "variance": "part * 52", "vol": "sign(part) * sqrt(abs(part) * 52)", "share": "part / (fv + sv)"}, "fp, tt", 6),
        "decompose_positions": final(_risk(), {"symbol!": None, "weight": None, "variance": "part * 52", "share": "part / (fv + sv)"}, "pos, tt", 6),
    }
