"""DuckDB SQL that computes the same results by other means than the Spark code."""

from __future__ import annotations

HORIZON = 5

TRADES = """
trades AS (
  SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

BAR_COLUMNS = """
  arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume"""

BARS = f"bars AS (SELECT ticker, date, {BAR_COLUMNS} FROM trades GROUP BY ticker, date)"

FLOWS = """
flows AS (
  SELECT ticker, date,
    CAST(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS inst,
    CAST(count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS fore
  FROM trades GROUP BY ticker, date
)"""

INDEX = """
idx AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS kospi
  FROM orders GROUP BY 1
)"""


def spine(start: str = "DATE '0001-01-01'") -> str:
    return f"""
request AS (SELECT max(date) - CAST(greatest(isodow(max(date)) - 5, 0) AS INTEGER) AS last_day FROM bars),
kept AS (SELECT * FROM bars WHERE date >= {start}),
firsts AS (SELECT ticker, min(date) AS first_day FROM kept WHERE isodow(date) < 6 GROUP BY ticker),
days AS (
  SELECT ticker, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS date
  FROM firsts, request
),
spine AS (SELECT * FROM days WHERE isodow(date) < 6)"""


JOINED = """
joined AS (
  SELECT s.ticker, s.date, open, high, low, close, volume, inst, fore, kospi
  FROM spine s
  LEFT JOIN kept b ON b.ticker = s.ticker AND b.date = s.date
  LEFT JOIN flows f ON f.ticker = s.ticker AND f.date = s.date
  LEFT JOIN idx i ON i.date = s.date
)"""

VALUES = ["open", "high", "low", "close", "volume", "inst", "fore", "kospi"]
FILLED = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in VALUES)
PANEL = f"""
panel AS (
  SELECT ticker, date, {FILLED} FROM joined
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)
)"""

INDICATED = """
steps AS (
  SELECT *, row_number() OVER w AS pos, volume * ((high + low + close) / 3) AS mf,
    CASE WHEN close >= lag(close) OVER w THEN volume WHEN close < lag(close) OVER w THEN -volume END AS step
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)
),
signs AS (
  SELECT *, CASE WHEN mf >= lag(mf) OVER w THEN 'p' WHEN mf < lag(mf) OVER w THEN 'n' END AS p_n
  FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date)
),
ratios AS (
  SELECT *, sum(step) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
    CASE WHEN pos >= 14 THEN
      (coalesce(sum(mf) FILTER (WHERE p_n = 'p') OVER f, 0) + 1)
      / (coalesce(sum(mf) FILTER (WHERE p_n = 'n') OVER f, 0) + 10) END AS mfr
  FROM signs WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)
),
indicated AS (
  SELECT *, 100 - 100 / (1 + mfr) AS mfi,
    CASE WHEN 100 - 100 / (1 + mfr) > 50 THEN 'buy' ELSE 'sell' END AS mfi_signal
  FROM ratios
)"""

DENSE = """
dense AS (
  SELECT ticker, date, close AS price, volume, inst, fore, kospi, obv, mfi, mfi_signal,
    row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS n
  FROM indicated
  WHERE close IS NOT NULL AND volume IS NOT NULL AND inst IS NOT NULL AND fore IS NOT NULL
    AND kospi IS NOT NULL AND obv IS NOT NULL AND mfi IS NOT NULL
)"""

FEATURES = ["close", "kospi", "mfi_signal_buy", "mfi_signal_sell", "obv", "trading_amount"]
FRAME = """
frame AS (
  SELECT ticker, date, rn, n, price, ln(1 + price) AS close, ln(1 + kospi) AS kospi,
    CASE WHEN mfi_signal = 'buy' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mfi_signal_buy,
    CASE WHEN mfi_signal = 'sell' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mfi_signal_sell,
    obv, ln(1 + price * volume) AS trading_amount, volume, inst, fore, mfi
  FROM dense
)"""


def staged(horizon: int = HORIZON) -> str:
    """Every row and step with its target and the bounds of its training sets."""
    return f"""
staged AS (
  SELECT f.*, h.horizon, t.price AS y, f.n - 2 * h.horizon AS n_train, f.n - h.horizon AS n_full
  FROM frame f CROSS JOIN (SELECT unnest(range(1, {horizon} + 1)) AS horizon) h
  LEFT JOIN frame t ON t.ticker = f.ticker AND t.rn = f.rn + h.horizon
)"""


ROLES = """
roles AS (
  SELECT *, unnest(list_filter([
    CASE WHEN rn = n - 1 THEN 'test' END, CASE WHEN rn < n_full THEN 'full' END,
    CASE WHEN rn = n_full - 1 THEN 'validation' END, CASE WHEN rn < n_train THEN 'train' END
  ], lambda x: x IS NOT NULL)) AS role FROM staged
)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


BASE = [TRADES, BARS, FLOWS, INDEX, spine()]
TO_PANEL = [*BASE, JOINED, PANEL]
TO_INDICATED = [*TO_PANEL, INDICATED]
TO_DENSE = [*TO_INDICATED, DENSE]
TO_FRAME = [*TO_DENSE, FRAME]
TO_STAGED = [*TO_FRAME, staged()]


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded value without a negative zero."""
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


# --- kNN -------------------------------------------------------------------


def knn_parts(ks: tuple[int, ...]) -> list[str]:
    bounds = ", ".join(
        f"min({c}) FILTER (WHERE rn < {limit}) AS lo_{c}_{name}, "
        f"coalesce(nullif(max({c}) FILTER (WHERE rn < {limit}) - min({c}) FILTER (WHERE rn < {limit}), 0), 1) AS sp_{c}_{name}"
        for c in FEATURES
        for name, limit in (("t", "n_train"), ("f", "n_full"))
    )
    distance = " + ".join(
        f"pow((q.{c} - d.{c}) / CASE WHEN q.role = 'test' THEN b.sp_{c}_f ELSE b.sp_{c}_t END, 2)" for c in FEATURES
    )
    means = ", ".join(f"avg(y) FILTER (WHERE nth <= {k}) AS yhat_{k}" for k in ks)
    return [
        f"bounds AS (SELECT ticker, horizon, {bounds} FROM staged GROUP BY ticker, horizon)",
        """
scored AS (
  SELECT *, CASE WHEN rn = n - 1 THEN 'test' WHEN rn = n_full - 1 THEN 'validation'
      WHEN rn BETWEEN n_train - 5 AND n_train - 1 THEN 'fold' || CAST(rn - (n_train - 5) AS VARCHAR) END AS role,
    CASE WHEN rn = n - 1 THEN n_full - 1 WHEN rn = n_full - 1 THEN n_train - 1 ELSE rn - 2 END AS last_row
  FROM staged
)""",
        f"""
near AS (
  SELECT q.ticker, q.horizon, q.role, q.y AS actual, d.y,
    row_number() OVER (PARTITION BY q.ticker, q.horizon, q.role ORDER BY {distance}, d.rn) AS nth
  FROM scored q
  JOIN bounds b ON b.ticker = q.ticker AND b.horizon = q.horizon
  JOIN staged d ON d.ticker = q.ticker AND d.horizon = q.horizon AND d.rn <= q.last_row
  WHERE q.role IS NOT NULL
)""",
        f"knn AS (SELECT ticker, horizon, role, max(actual) AS y, {means} FROM near GROUP BY ticker, horizon, role)",
    ]


KNN_CHOICE = """
scores AS (
  SELECT ticker, horizon, k, avg(CASE k WHEN 3 THEN abs(y - yhat_3) WHEN 5 THEN abs(y - yhat_5) ELSE abs(y - yhat_7) END) AS mean_score
  FROM knn, (VALUES (3), (5), (7)) AS grid(k) WHERE role LIKE 'fold%' GROUP BY ticker, horizon, k
),
chosen AS (SELECT ticker, horizon, arg_min(k, (mean_score, k)) AS k, min(mean_score) AS mean_score FROM scores GROUP BY ticker, horizon)"""

KNN_TUNED = f"""
{KNN_CHOICE},
knn_tuned AS (
  SELECT ticker, horizon, role, y, CASE k WHEN 3 THEN yhat_3 WHEN 5 THEN yhat_5 ELSE yhat_7 END AS y_hat, k
  FROM knn JOIN chosen USING (ticker, horizon) WHERE role IN ('validation', 'test')
)"""

# --- linear regression by Cholesky factors ---------------------------------

# The sell flag is one minus the buy flag, so it adds nothing to the fit.
INDEPENDENT = [c for c in FEATURES if c != "mfi_signal_sell"]


def linear_parts() -> list[str]:
    cols = INDEPENDENT
    p = len(cols)
    # A column without spread, or that the ones before it determine, gets weight zero.
    sums = [f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}" for i, c in enumerate(cols)]
    sums += [f"covar_pop({cols[i]}, {cols[j]}) / (s{i} * s{j}) AS c{i}{j}" for i in range(p) for j in range(i)]
    sums += [f"covar_pop({c}, y) / s{i} AS b{i}" for i, c in enumerate(cols)]
    lines = []
    for j in range(p):
        dot = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        lines.append(f"CASE WHEN 1.0{dot} > 1e-10 THEN sqrt(1.0{dot}) END AS l{j}{j}")
        for i in range(j + 1, p):
            dot = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            lines.append(f"coalesce((c{i}{j}{dot}) / l{j}{j}, 0) AS l{i}{j}")
    for i in range(p):
        dot = "".join(f" - l{i}{k} * z{k}" for k in range(i))
        lines.append(f"coalesce((b{i}{dot}) / l{i}{i}, 0) AS z{i}")
    for i in reversed(range(p)):
        dot = "".join(f" - l{k}{i} * w{k}" for k in range(i + 1, p))
        lines.append(f"coalesce((z{i}{dot}) / l{i}{i}, 0) AS w{i}")
    predicted = " + ".join(f"w{i} * (x.{c} - m{i}) / s{i}" for i, c in enumerate(cols))
    return [
        f"""
fitted AS MATERIALIZED (
  SELECT ticker, horizon, CASE role WHEN 'train' THEN 'validation' ELSE 'test' END AS role, avg(y) AS my, {', '.join(sums)}
  FROM roles WHERE role IN ('train', 'full') GROUP BY ticker, horizon, 3
)""",
        # One stored step per number, as inlined aliases would grow without end.
        *[
            f"solve{i} AS MATERIALIZED (SELECT *, {line} FROM {f'solve{i - 1}' if i else 'fitted'})"
            for i, line in enumerate(lines)
        ],
        f"solved AS (SELECT * FROM solve{len(lines) - 1})",
        f"""
linear AS (
  SELECT x.ticker, x.horizon, x.role, x.y, my + {predicted} AS y_hat
  FROM solved s JOIN roles x ON x.ticker = s.ticker AND x.horizon = s.horizon AND x.role = s.role
)""",
    ]


def pooled_parts() -> list[str]:
    """The same for all tickers together, on the change of the logged price."""
    cols = [*INDEPENDENT, "close_level"]
    p = len(cols)
    sums = [f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}" for i, c in enumerate(cols)]
    sums += [f"covar_pop({cols[i]}, {cols[j]}) / (s{i} * s{j}) AS c{i}{j}" for i in range(p) for j in range(i)]
    sums += [f"covar_pop({c}, label) / s{i} AS b{i}" for i, c in enumerate(cols)]
    lines = []
    for j in range(p):
        dot = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        lines.append(f"CASE WHEN 1.0{dot} > 1e-10 THEN sqrt(1.0{dot}) END AS l{j}{j}")
        for i in range(j + 1, p):
            dot = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            lines.append(f"coalesce((c{i}{j}{dot}) / l{j}{j}, 0) AS l{i}{j}")
    for i in range(p):
        dot = "".join(f" - l{i}{k} * z{k}" for k in range(i))
        lines.append(f"coalesce((b{i}{dot}) / l{i}{i}, 0) AS z{i}")
    for i in reversed(range(p)):
        dot = "".join(f" - l{k}{i} * w{k}" for k in range(i + 1, p))
        lines.append(f"coalesce((z{i}{dot}) / l{i}{i}, 0) AS w{i}")
    predicted = " + ".join(f"w{i} * (x.{c} - m{i}) / s{i}" for i, c in enumerate(cols))
    return [
        """
levels AS (
  SELECT *, avg(close) OVER (PARTITION BY ticker, horizon ORDER BY date ROWS UNBOUNDED PRECEDING) AS close_level,
    ln(1 + y) - ln(1 + price) AS label
  FROM staged
)""",
        ROLES.replace("roles AS", "pooled_roles AS").replace("FROM staged", "FROM levels"),
        f"""
fitted AS MATERIALIZED (
  SELECT horizon, CASE role WHEN 'train' THEN 'validation' ELSE 'test' END AS role, avg(label) AS my, {', '.join(sums)}
  FROM pooled_roles WHERE role IN ('train', 'full') GROUP BY horizon, 2
)""",
        *[
            f"solve{i} AS MATERIALIZED (SELECT *, {line} FROM {f'solve{i - 1}' if i else 'fitted'})"
            for i, line in enumerate(lines)
        ],
        f"""
pooled AS (
  SELECT x.ticker, x.horizon, x.role, x.y, exp(ln(1 + price) + my + {predicted}) - 1 AS y_hat
  FROM solve{len(lines) - 1} s JOIN pooled_roles x ON x.horizon = s.horizon AND x.role = s.role
)""",
    ]


# --- ARIMA -----------------------------------------------------------------


def arima_parts(horizon: int = HORIZON) -> list[str]:
    return [
        """
moved AS (
  SELECT ticker, rn, n, price, price - lag(price) OVER w AS d,
    price - 2 * lag(price) OVER w + lag(price, 2) OVER w AS w2
  FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY date)
),
pairs AS (SELECT *, lag(w2) OVER (PARTITION BY ticker ORDER BY rn) AS w1 FROM moved)""",
        f"""
ends AS (
  SELECT ticker, h AS horizon, role, CASE role WHEN 'test' THEN n - 1 ELSE n - 1 - h END AS last_row, n
  FROM (SELECT DISTINCT ticker, n FROM moved), (SELECT unnest(range(1, {horizon} + 1)) AS h), (VALUES ('test'), ('validation')) AS r(role)
),
phis AS (
  SELECT e.ticker, e.horizon, e.role, e.last_row, e.n, sum(2 * p.w2 * p.w1) / nullif(sum(p.w1 * p.w1 + p.w2 * p.w2), 0) AS phi
  FROM ends e JOIN pairs p ON p.ticker = e.ticker AND p.rn <= e.last_row AND p.w1 IS NOT NULL
  GROUP BY ALL
),
arima AS (
  SELECT f.ticker, f.horizon, f.role, CASE f.role WHEN 'validation' THEN z.price END AS y,
    p.price + f.horizon * p.d + p.w2 * list_sum(list_transform(range(1, f.horizon + 1), lambda j: (f.horizon - j + 1) * pow(f.phi, j))) AS y_hat
  FROM phis f JOIN pairs p ON p.ticker = f.ticker AND p.rn = f.last_row
  JOIN pairs z ON z.ticker = f.ticker AND z.rn = f.n - 1
)""",
    ]


def predictions(*models: str) -> str:
    tables = {"Linear": "linear", "KNN": "knn_tuned", "ARIMA": "arima"}
    union = " UNION ALL ".join(
        f"SELECT ticker, '{m}' AS model, horizon, role, y, y_hat FROM {tables[m]}" for m in models
    )
    return f"predictions AS ({union})"


def measures(y: str = "y", p: str = "y_hat") -> dict[str, str]:
    mae, rmse, level = f"avg(abs({y} - {p}))", f"sqrt(avg(({y} - {p}) * ({y} - {p})))", f"avg(abs({y}))"
    return {
        "mae": mae,
        "mape": f"avg(abs({y} - {p}) / greatest(abs({y}), 2.220446049250313e-16))",
        "nmae": f"{mae} / {level}",
        "rmse": rmse,
        "nrmse": f"{rmse} / {level}",
        "r2": f"CASE WHEN count({y}) >= 2 AND var_pop({y}) > 0 THEN 1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y})) END",
    }


PERFORMANCE = f"""
perf AS (
  SELECT ticker, model, horizon, {', '.join(f'{e} AS {c}' for c, e in measures().items())}
  FROM predictions WHERE role = 'validation' GROUP BY ticker, model, horizon
)"""

BOARD = f"""
score AS (
  SELECT ticker, model, horizon, nmae * 100 AS score, CAST(NULL AS DOUBLE) AS running_time FROM perf
  UNION ALL SELECT ticker, 'best_model', horizon, min(nmae) * 100, -1.0 FROM perf GROUP BY ticker, horizon
),
board AS (
  SELECT ticker, model, {', '.join(f'max(score) FILTER (WHERE horizon = {h}) AS time_gap_{h}' for h in range(1, HORIZON + 1))},
    avg(score) AS avg, stddev_samp(score) AS std, avg(running_time) AS running_time
  FROM score GROUP BY ticker, model
)"""

ALL_MODELS = [*TO_STAGED, ROLES, *linear_parts(), *knn_parts((3, 5, 7)), KNN_TUNED, *arima_parts()]
TO_PERFORMANCE = [*ALL_MODELS, predictions("Linear", "KNN", "ARIMA"), PERFORMANCE]


def forecast_rows(table: str, extra: str = "") -> str:
    return f"SELECT ticker, horizon, role, {r('y', 3)}, {r('y_hat', 3)}{extra} FROM {table}"


def plus_days(day: str, n: str) -> str:
    """Step through the calendar: the n-th weekday after the day."""
    return (
        f"list_extract(list_filter(list_transform(range(1, CAST({n} AS BIGINT) * 2 + 5), lambda i: {day} + CAST(i AS INTEGER)), "
        f"lambda x: isodow(x) < 6), {n})"
    )


def minus_days(day: str, n: str) -> str:
    return plus_days(day, n).replace(f"{day} + CAST(i AS INTEGER)", f"{day} - CAST(i AS INTEGER)")


def job(models: list[str], parts: list[str], horizon: int) -> str:
    shown = measures()
    return (
        ctes(*parts, predictions(*models))
        + f"""SELECT ticker, model, horizon, {plus_days('last_day', 'horizon')} AS date,
  round_even(max(y_hat) FILTER (WHERE role = 'test'), 0) + 0.0 AS forecast,
  {', '.join(r(e, 5, c) for c, e in shown.items())}
FROM predictions, request GROUP BY ticker, model, horizon, last_day"""
    )


REQUEST_START = f"(SELECT {minus_days('last_day', '250')} FROM request)"
REQUEST_SPINE = spine().replace("DATE '0001-01-01'", REQUEST_START)
REQUEST_PARTS = [
    TRADES, BARS, FLOWS, INDEX, REQUEST_SPINE, JOINED, PANEL, INDICATED, DENSE, FRAME, staged(20), ROLES,
    *linear_parts(), *knn_parts((3, 5, 7)), KNN_TUNED, *arima_parts(20),
]

FINE_TRADES = """
trades AS (
  SELECT n_name AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
FINE_PARTS = [
    FINE_TRADES, BARS, FLOWS, INDEX, REQUEST_SPINE, JOINED, PANEL, INDICATED, DENSE, FRAME, staged(), ROLES,
    *linear_parts(), *knn_parts((3, 5, 7)), KNN_TUNED, *arima_parts(),
]

# All trades set the request date; the company's alone make its bars.
COMPANY_TRADES = """
all_trades AS (
  SELECT c_name, lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS ticker,
    CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey
),
trades AS (SELECT * FROM all_trades WHERE c_name = 'Customer#000000003')"""
COMPANY_SPINE = REQUEST_SPINE.replace("AS last_day FROM bars", "AS last_day FROM all_trades").replace(
    minus_days("last_day", "250"), minus_days("last_day", "2000")
)
COMPANY_PARTS = [
    COMPANY_TRADES, BARS, FLOWS, INDEX, COMPANY_SPINE, JOINED, PANEL, INDICATED, DENSE, FRAME, staged(), ROLES,
    *knn_parts((3, 5, 7)), KNN_TUNED, *arima_parts(),
]


def fixed_net(alpha: float, ratio: float, sweeps: int = 300) -> list[str]:
    """Coordinate descent as a recursive query over the covariances of every fit."""
    cols, p = FEATURES, len(FEATURES)
    sums = [f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}" for i, c in enumerate(cols)]
    sums += [f"covar_pop({cols[i]}, {cols[j]}) / (s{i} * s{j}) AS c{i}{j}" for i in range(p) for j in range(i + 1)]
    sums += [f"covar_pop({c}, y) / s{i} AS b{i}" for i, c in enumerate(cols)]
    body = "SELECT * FROM descent JOIN moments USING (ticker, horizon, role) WHERE sweep < " + str(sweeps)
    for j in range(p):
        others = " - ".join([f"b{j}", *(f"c{max(i, j)}{min(i, j)} * w{i}" for i in range(p) if i != j)])
        shrunk = f"sign({others}) * greatest(abs({others}) - {alpha * ratio}::DOUBLE, 0)"
        kept = ", ".join(f"w{i}" if i != j else f"CASE WHEN c{j}{j} > 0 THEN {shrunk} / (c{j}{j} + {alpha * (1 - ratio)}::DOUBLE) ELSE 0.0::DOUBLE END AS w{j}" for i in range(p))
        rest = ", ".join([*(f"c{i}{k}" for i in range(p) for k in range(i + 1)), *(f"b{i}" for i in range(p))])
        body = f"SELECT ticker, horizon, role, sweep, {kept}, {rest} FROM ({body})"
    ws = ", ".join(f"w{i}" for i in range(p))
    start = ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(p))
    predicted = " + ".join(f"w{i} * (x.{c} - m{i}) / s{i}" for i, c in enumerate(cols))
    return [
        f"""
moments AS MATERIALIZED (
  SELECT ticker, horizon, CASE role WHEN 'train' THEN 'validation' ELSE 'test' END AS role, avg(y) AS my, {', '.join(sums)}
  FROM roles WHERE role IN ('train', 'full') GROUP BY ticker, horizon, 3
)""",
        f"""
descent AS (
  SELECT ticker, horizon, role, 0 AS sweep, {start} FROM moments
  UNION ALL SELECT ticker, horizon, role, sweep + 1, {ws} FROM ({body})
)""",
        f"""
net AS (
  SELECT x.ticker, x.horizon, x.role, x.y, my + {predicted} AS y_hat
  FROM descent d JOIN moments m USING (ticker, horizon, role)
  JOIN roles x ON x.ticker = d.ticker AND x.horizon = d.horizon AND x.role = d.role WHERE sweep = {sweeps}
)""",
    ]


METRIC_NAMES = (
    "yoy_avg_revenue yoy_avg_operating_income yoy_avg_ebitda yoy_avg_eps quick_ratio receivable_turnover_ratio "
    "asset_turnover_ratio debt_to_equity_ratio icr revenue operating_income operating_margin ebitda ebitda_margin "
    "roe cfo_to_earnings per shareholder_return"
).split()
KNOWN_METRICS = {
    "yoy_avg_revenue": "avg(g)", "yoy_avg_operating_income": "avg(h)", "revenue": "arg_max(revenue, y)",
    "operating_income": "arg_max(income, y)", "operating_margin": "arg_max(income, y) / arg_max(revenue, y)",
    "quick_ratio": "arg_max_null(settled, y) / nullif(arg_max(revenue, y) - arg_max_null(settled, y), 0)",
    "receivable_turnover_ratio": "arg_max(revenue, y) / nullif(arg_max_null(open, y), 0)",
    "cfo_to_earnings": "arg_max_null(cash, y) / nullif(arg_max(income, y), 0)",
}
METRIC_ROWS = (
    """
line_income AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))) AS income
  FROM lineitem GROUP BY 1
),
sold AS (
  SELECT n_name AS company, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(income) AS DOUBLE) AS income,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS open,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS settled
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN line_income ON l_orderkey = o_orderkey
  GROUP BY ALL
),
flown AS (
  SELECT n_name AS company, year(l_shipdate) AS y,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))))) AS DOUBLE) AS cash
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY ALL
),
yearly AS (SELECT * FROM sold LEFT JOIN flown USING (company, y)),
grown AS (SELECT *, revenue / lag(revenue) OVER w - 1 AS g, income / lag(income) OVER w - 1 AS h FROM yearly WINDOW w AS (PARTITION BY company ORDER BY y)),
metric_rows AS ("""
    + " UNION ALL ".join(
        f"SELECT company, '{m}' AS metric, {f'round({KNOWN_METRICS[m]}, 4) + 0.0' if m in KNOWN_METRICS else 'CAST(NULL AS DOUBLE)'} AS value FROM grown GROUP BY company"
        for m in METRIC_NAMES
    )
    + ")"
)

FORECASTS = f"""
forecasts AS (
  SELECT ticker, {plus_days('last_day', 'horizon')} AS date, round_even(y_hat, 0) AS close
  FROM arima, request WHERE role = 'test'
)"""


def chart(closes: str, average: int, tick: int) -> str:
    return f"""
series AS (
  SELECT ticker, date, price AS close, 'actual' AS part FROM {closes}
  UNION ALL SELECT ticker, date, close, 'predicted' FROM forecasts
)
SELECT ticker, date, part, {r('close')},
  {r(f"CASE WHEN count(close) OVER m >= {average} THEN avg(close) OVER m END", 6, 'moving_average')},
  date = min(date) FILTER (WHERE part = 'predicted') OVER (PARTITION BY ticker) AS is_boundary,
  (row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1) % {tick} = 0 AS is_tick
FROM series WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {average - 1} PRECEDING AND CURRENT ROW)"""


def ewm(table: str, column: str, name: str) -> str:
    """Direct weighted sums over all earlier rows, span 5, five known values needed."""
    return f"""
{name} AS (
  SELECT a.ticker, a.pos,
    CASE WHEN max(a.known) >= 5 THEN sum(pow(2.0 / 3, a.pos - b.pos) * b.{column}) / sum(pow(2.0 / 3, a.pos - b.pos)) END AS {name}
  FROM (SELECT *, count({column}) OVER (PARTITION BY ticker ORDER BY pos) AS known FROM {table}) a
  LEFT JOIN {table} b ON b.ticker = a.ticker AND b.pos <= a.pos AND b.{column} IS NOT NULL
  GROUP BY a.ticker, a.pos
)"""


def scaled(centre: str, scale: str) -> str:
    stats = ", ".join(f"{centre.format(c=c)} AS m_{c}, coalesce(nullif({scale.format(c=c)}, 0), 1) AS s_{c}" for c in FEATURES)
    shown = ", ".join(r(f"(x.{c} - m_{c}) / s_{c}", 6, c) for c in FEATURES)
    return (
        ctes(*TO_STAGED, ROLES, f"stats AS (SELECT ticker, horizon, role AS fit, {stats} FROM roles WHERE role IN ('train', 'full') GROUP BY ticker, horizon, role)")
        + f"""SELECT x.ticker, x.date, x.horizon, x.role, {shown} FROM roles x JOIN stats s
ON s.ticker = x.ticker AND s.horizon = x.horizon AND s.fit = CASE WHEN x.role IN ('train', 'validation') THEN 'train' ELSE 'full' END"""
    )


CORR_COLUMNS = sorted([*FEATURES, "volume", "inst", "fore", "mfi", "y"])
CORR = " UNION ALL ".join(
    f"SELECT ticker, '{a}' AS col_a, '{b}' AS col_b, CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN round(corr({a}, {b}), 3) + 0.0 END AS corr FROM staged WHERE horizon = 1 AND y IS NOT NULL GROUP BY ticker"
    for i, a in enumerate(CORR_COLUMNS)
    for b in CORR_COLUMNS[i + 1 :]
)

CUSTOMER_LISTING = """SELECT c_name AS name, lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS code, c_mktsegment AS market FROM customer"""
SUPPLIER_LISTING = """SELECT s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), greatest(6, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0') AS code, 'SUPPLIER' AS market FROM supplier"""

OWNED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
EARNED = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))"
CASH = f"CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * ({EARNED})"
STATEMENTS = " UNION ALL ".join(
    f"""
SELECT r_name AS sector, n_name AS company, '{statement}' AS statement, {label} AS label,
  make_date(year(o_orderdate), 12, 31) AS period, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS value
FROM {OWNED} GROUP BY ALL"""
    for statement, label in (("cis", "o_orderpriority"), ("bs", "'orders ' || o_orderstatus"))
) + f"""
UNION ALL SELECT r_name, n_name, 'cf', CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'shipped' END AS label,
  make_date(year(l_shipdate), 12, 31) AS period, round(CAST(sum({CASH}) AS DOUBLE), 2)
FROM {OWNED} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""

SHIFTS = ", ".join(
    f"{plus_days('date', str(n))} AS plus_{n}, {minus_days('date', str(n))} AS minus_{n}" for n in (1, 5, 20, 250)
)

IMPUTED = [*VALUES, "weekday"]


def imputed() -> str:
    """Every open cell against every donor of its ticker, nearest five kept."""
    shared = " + ".join(f"CAST(q.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)" for c in IMPUTED)
    square = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in IMPUTED)
    parts = ["known AS (SELECT *, CAST(isodow(date) - 1 AS DOUBLE) AS weekday FROM joined)"]
    for c in IMPUTED:
        parts.append(f"""
near_{c} AS (
  SELECT q.ticker, q.date, d.{c} AS v, row_number() OVER (PARTITION BY q.ticker, q.date
    ORDER BY ({square}) * ({len(IMPUTED)}.0::DOUBLE / ({shared})), d.date) AS nth
  FROM known q JOIN known d ON d.ticker = q.ticker
  WHERE q.{c} IS NULL AND d.{c} IS NOT NULL AND {shared} > 0
),
fill_{c} AS (SELECT ticker, date, avg(v) AS v FROM near_{c} WHERE nth <= 5 GROUP BY ticker, date),
mean_{c} AS (SELECT ticker, avg({c}) AS m, min({c}) AS lo, max({c}) AS hi FROM known GROUP BY ticker)""")
    whole = {"volume", "weekday"}
    shown = []
    for c in IMPUTED:
        value = f"coalesce(k.{c}, fill_{c}.v, mean_{c}.m)"
        if c in whole:
            value = f"least(greatest(round_even({value}, 0), mean_{c}.lo), mean_{c}.hi)"
        shown.append(r(value, 6, c))
    joins = "".join(
        f"LEFT JOIN fill_{c} ON fill_{c}.ticker = k.ticker AND fill_{c}.date = k.date "
        f"LEFT JOIN mean_{c} ON mean_{c}.ticker = k.ticker\n"
        for c in IMPUTED
    )
    return ctes(*BASE, JOINED, *parts) + f"SELECT k.ticker, k.date, {', '.join(shown)} FROM known k\n{joins}"


FIRST_SECTORS = """WITH sales AS (
  SELECT p_type AS sector, p_brand AS company, CASE WHEN l_returnflag = 'R' THEN 'bs' ELSE 'cis' END AS statement, l_linestatus AS label,
    make_date(year(l_shipdate), 12, 31) AS period, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT * FROM sales s WHERE sector = (SELECT min(sector) FROM sales f WHERE f.company = s.company)"""


def imputed_table(rows: str, key: str, block: str | None, columns: list[str], whole: set[str] = frozenset()) -> str:
    """Every open cell of any table against every donor of its block, nearest five kept."""
    same = f"d.{block} = q.{block}" if block else "TRUE"
    shared = " + ".join(f"CAST(q.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)" for c in columns)
    square = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in columns)
    parts, shown, joins = [f"known AS ({rows})"], [f"k.{key}", *([f"k.{block}"] if block else [])], ""
    for c in columns:
        parts.append(f"""
near_{c} AS (
  SELECT q.{key} AS key, d.{c} AS v, row_number() OVER (PARTITION BY q.{key}
    ORDER BY ({square}) * ({len(columns)}.0::DOUBLE / ({shared})), d.{key}) AS nth
  FROM known q JOIN known d ON {same} WHERE q.{c} IS NULL AND d.{c} IS NOT NULL AND {shared} > 0
),
fill_{c} AS (SELECT key, avg(v) AS v FROM near_{c} WHERE nth <= 5 GROUP BY key),
mean_{c} AS (SELECT {block or '1'} AS block, avg({c}) AS m, min({c}) AS lo, max({c}) AS hi FROM known GROUP BY 1)""")
        value = f"coalesce(k.{c}, fill_{c}.v, mean_{c}.m)"
        if c in whole:
            value = f"least(greatest(round_even({value}, 0), mean_{c}.lo), mean_{c}.hi)"
        shown.append(r(value, 6, c))
        joins += f"LEFT JOIN fill_{c} ON fill_{c}.key = k.{key} LEFT JOIN mean_{c} ON mean_{c}.block = {f'k.{block}' if block else '1'}\n"
    return ctes(*parts) + f"SELECT {', '.join(shown)} FROM known k\n{joins}"


ORACLES: dict[str, str] = {
    "impute_customers": imputed_table(
        "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer",
        "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"],
    ),
    "impute_parts": imputed_table(
        "SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part",
        "p_partkey", None, ["p_size", "p_retailprice"], {"p_size"},
    ),
    "scan_listing": f"SELECT * FROM ({CUSTOMER_LISTING}) WHERE market IN ('BUILDING', 'MACHINERY')",
    "listing_union": f"{CUSTOMER_LISTING} UNION ALL {SUPPLIER_LISTING}",
    "listing_sorted": f"SELECT * FROM ({CUSTOMER_LISTING} UNION ALL {SUPPLIER_LISTING}) ORDER BY name, code",
    "listing_lookup": f"SELECT name, min(code) AS code, arg_min(market, code) AS market FROM ({CUSTOMER_LISTING}) l WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = CAST(l.code AS BIGINT)) GROUP BY name",
    "bars_daily": ctes(TRADES, BARS) + "SELECT * FROM bars",
    "bars_roundtrip": ctes(TRADES, BARS) + "SELECT * FROM bars",
    "bars_fine": f"""SELECT n_name AS ticker, CAST(o_orderdate AS DATE) AS date, {BAR_COLUMNS}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "flows_daily": ctes(TRADES, FLOWS) + "SELECT * FROM flows",
    "index_daily": ctes(INDEX) + "SELECT date, kospi FROM idx",
    "business_days": ctes(TRADES, BARS)
    + """SELECT ticker, date FROM (SELECT ticker, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
FROM bars GROUP BY ticker) WHERE isodow(date) < 6""",
    "bday_shift": f"""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
shifted AS (SELECT date, {SHIFTS} FROM days)
SELECT o_orderkey, s.*, strftime(plus_1, '%Y%m%d') AS compact FROM orders JOIN shifted s ON s.date = CAST(o_orderdate AS DATE)""",
    "week_of_month": "SELECT o_orderkey, CAST((day(o_orderdate) + 6) // 7 AS BIGINT) AS week FROM orders",
    "spine_join": ctes(*BASE, JOINED) + "SELECT * FROM joined",
    "ffill": ctes(*TO_PANEL) + "SELECT * FROM panel",
    "null_audit": ctes(*BASE, JOINED)
    + "SELECT "
    + ", ".join(f"count(*) - count({c}) AS {c}_nulls" for c in ["ticker", "date", *VALUES])
    + ", "
    + " + ".join(f"count(*) - count({c})" for c in ["ticker", "date", *VALUES])
    + " AS total_nulls FROM joined",
    "min_history": ctes(*BASE[:-1], REQUEST_SPINE, JOINED, PANEL)
    + "SELECT ticker, count(*) AS n_days, CAST(60 AS BIGINT) AS required, count(*) >= 60 AS enough FROM panel GROUP BY ticker",
    "stride_sample": ctes(*TO_PANEL)
    + """SELECT ticker, date, close, CAST(step AS BIGINT) AS step FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back FROM panel), (VALUES (5), (20)) AS s(step)
WHERE back % step = 0""",
    "obv": ctes(*TO_INDICATED) + "SELECT ticker, date, close, volume, obv FROM indicated",
    "mfi": ctes(*TO_INDICATED) + f"SELECT ticker, date, {r('mf')}, p_n, {r('mfr')}, {r('mfi')} FROM indicated",
    "mfi_signal": ctes(*TO_INDICATED) + f"SELECT ticker, date, {r('mfi')}, mfi_signal FROM indicated WHERE mfi IS NOT NULL",
    "stochastic": ctes(
        *TO_PANEL,
        """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos,
    CASE WHEN count(high) OVER f >= 14 THEN max(high) OVER f END AS hi, CASE WHEN count(low) OVER f >= 14 THEN min(low) OVER f END AS lo
  FROM panel WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
),
fast AS (SELECT *, (close - lo) / nullif(hi - lo, 0) * 100 AS fast_k FROM numbered)""",
        ewm("fast", "fast_k", "slow_k"),
        ewm("slow_k", "slow_k", "slow_d"),
    )
    + f"""SELECT ticker, date, {r('fast_k')}, {r('slow_k', 6, 'fast_d')}, {r('slow_k')}, {r('slow_d')}
FROM fast JOIN slow_k USING (ticker, pos) JOIN slow_d USING (ticker, pos)""",
    "ewm_mean": ctes(
        *BASE, JOINED, "numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM joined)",
        ewm("numbered", "close", "ewm"),
    )
    + f"SELECT ticker, date, {r('close')}, {r('ewm', 4)} FROM numbered JOIN ewm USING (ticker, pos)",
    "moving_avg": ctes(*TO_PANEL)
    + f"""SELECT ticker, date, {r('CASE WHEN count(close) OVER a >= 20 THEN avg(close) OVER a END', 6, 'ma20')},
  {r('CASE WHEN count(close) OVER b >= 5 THEN avg(close) OVER b END', 6, 'ma5')} FROM panel
WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "breakthrough": ctes(
        *TO_INDICATED,
        """
crossed AS (
  SELECT ticker, date, close, pos, obv, CASE WHEN count(obv) OVER a >= 20 THEN avg(obv) OVER a END AS ma20,
    lead(close, 1) OVER w AS c1, lead(close, 2) OVER w AS c2
  FROM indicated WINDOW w AS (PARTITION BY ticker ORDER BY date),
    a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
),
cand AS (
  SELECT *, CASE WHEN obv > ma20 AND coalesce(c1 > close, TRUE) AND coalesce(c2 > close, TRUE) THEN 'buy'
    WHEN obv < ma20 AND coalesce(c1 < close, TRUE) AND coalesce(c2 < close, TRUE) THEN 'sell' END AS cand FROM crossed
),
firsts_of AS (SELECT ticker, arg_min(cand, pos) AS opening FROM cand WHERE cand IS NOT NULL GROUP BY ticker)""",
    )
    + """SELECT c.ticker, date, close, coalesce(last_value(cand IGNORE NULLS) OVER (PARTITION BY c.ticker ORDER BY pos ROWS UNBOUNDED PRECEDING),
  CASE WHEN pos > 1 THEN CASE opening WHEN 'buy' THEN 'sell' WHEN 'sell' THEN 'buy' END END) AS signal
FROM cand c LEFT JOIN firsts_of USING (ticker)""",
    "features": ctes(*TO_FRAME)
    + f"""SELECT ticker, date, {r('close')}, {r('kospi')}, CAST(mfi_signal_buy AS BIGINT) AS mfi_signal_buy,
  CAST(mfi_signal_sell AS BIGINT) AS mfi_signal_sell, {r('obv')}, {r('trading_amount')} FROM frame""",
    "features_ohlcv_only": ctes(*TO_INDICATED)
    + f"""SELECT ticker, date, {r('ln(1 + close)', 6, 'close')}, CAST(mfi_signal = 'buy' AS BIGINT) AS mfi_signal_buy,
  CAST(mfi_signal = 'sell' AS BIGINT) AS mfi_signal_sell, {r('obv')}, {r('ln(1 + close * volume)', 6, 'trading_amount')}
FROM indicated WHERE obv IS NOT NULL AND mfi IS NOT NULL""",
    "targets": ctes(*TO_DENSE)
    + f"""SELECT d.ticker, d.date, h.horizon, t.price AS y FROM dense d CROSS JOIN (SELECT unnest(range(0, {HORIZON} + 1)) AS horizon) h
LEFT JOIN dense t ON t.ticker = d.ticker AND t.rn = d.rn + h.horizon""",
    "sequence_windows": ctes(*TO_STAGED)
    + f"""SELECT e.ticker, e.date, CAST(s.step AS BIGINT) AS step, {', '.join(r(f'x.{c}', 6, c) for c in FEATURES)}, {r('e.y', 6, 'y')}
FROM staged e CROSS JOIN (SELECT unnest(range(0, 5)) AS step) s JOIN frame x ON x.ticker = e.ticker AND x.rn = e.rn - 4 + s.step
WHERE e.horizon = 1 AND e.y IS NOT NULL AND e.rn >= 4""",
    "split_walkforward": ctes(*TO_STAGED, ROLES) + "SELECT ticker, date, rn, horizon, role, y FROM roles",
    "ts_folds": ctes(*TO_STAGED)
    + """SELECT ticker, horizon, date, rn, f.fold, CASE WHEN rn = n_train - 5 + f.fold THEN 'test' ELSE 'train' END AS fold_role
FROM staged CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) f
WHERE rn = n_train - 5 + f.fold OR rn <= n_train - 7 + f.fold""",
    "kfold_hash": ctes(*TO_DENSE)
    + """SELECT ticker, date, ntile(10) OVER (PARTITION BY ticker ORDER BY md5(concat_ws('|', ticker, CAST(date AS VARCHAR), '2323')), date) - 1 AS fold FROM dense""",
    "standard_scale": scaled("avg({c})", "stddev_pop({c})"),
    "minmax_scale": scaled("min({c})", "max({c}) - min({c})"),
    "corr_matrix": ctes(*TO_STAGED) + CORR,
    "label_encode": """WITH p AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
s AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM orders))
SELECT o_orderkey, p.code AS o_orderpriority, s.code AS o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS o_custkey
FROM orders LEFT JOIN p ON p.v = o_orderpriority LEFT JOIN s ON s.v = o_orderstatus""",
    "one_hot_long": """SELECT event_id, 'event_type' AS col, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events WHERE event_type IS NOT NULL
UNION ALL SELECT event_id, 'user_id', dense_rank() OVER (ORDER BY user_id) - 1 FROM events WHERE user_id IS NOT NULL""",
    "knn_impute": imputed(),
    "one_hot": "SELECT event_id, "
    + ", ".join(
        f"CAST(event_type = '{e}' AS BIGINT) AS event_type_{e}" for e in ("click", "error", "purchase", "signup", "view")
    )
    + ", user_id FROM events",
    "linear_1f": ctes(*TO_STAGED, ROLES,
        "lines AS (SELECT ticker, horizon, CASE role WHEN 'train' THEN 'validation' ELSE 'test' END AS role, regr_slope(y, close) AS a, regr_intercept(y, close) AS b FROM roles WHERE role IN ('train', 'full') GROUP BY ticker, horizon, 3)",
        "one AS (SELECT x.ticker, x.horizon, x.role, x.y, a * x.close + b AS y_hat FROM lines l JOIN roles x ON x.ticker = l.ticker AND x.horizon = l.horizon AND x.role = l.role)")
    + forecast_rows("one"),
    "linear_forecast": ctes(*TO_STAGED, ROLES, *linear_parts()) + forecast_rows("linear"),
    "linear_pretrained": ctes(*TO_STAGED, ROLES, *linear_parts()) + forecast_rows("linear"),
    "elasticnet_pretrained": ctes(*TO_STAGED, ROLES, *fixed_net(1.0, 0.5)).replace("WITH", "WITH RECURSIVE", 1)
    + forecast_rows("net", ", 1.0::DOUBLE AS alpha, 0.5::DOUBLE AS l1_ratio"),
    "linear_pooled": ctes(*TO_STAGED, *pooled_parts())
    + f"SELECT ticker, horizon, role, {r('y', 2)}, {r('y_hat', 2)} FROM pooled",
    "knn_pretrained": ctes(*TO_STAGED, *knn_parts((3, 5, 7)), KNN_TUNED) + forecast_rows("knn_tuned", ", CAST(k AS BIGINT) AS k"),
    "arima_pretrained": ctes(*TO_DENSE, *arima_parts()) + forecast_rows("arima"),
    "knn_forecast": ctes(*TO_STAGED, *knn_parts((5,)))
    + f"SELECT ticker, horizon, role, {r('y', 3)}, {r('yhat_5', 3, 'y_hat')}, CAST(5 AS BIGINT) AS k FROM knn WHERE role IN ('validation', 'test')",
    "knn_tuned": ctes(*TO_STAGED, *knn_parts((3, 5, 7)), KNN_TUNED) + forecast_rows("knn_tuned", ", CAST(k AS BIGINT) AS k"),
    "grid_best": ctes(*TO_STAGED, *knn_parts((3, 5, 7)), KNN_CHOICE)
    + f"SELECT ticker, horizon, CAST(k AS BIGINT) AS k, {r('mean_score', 3)} FROM chosen",
    "arima_forecast": ctes(*TO_DENSE, *arima_parts()) + forecast_rows("arima"),
    "goss_sample": ctes(
        *TO_STAGED,
        "changes AS (SELECT ticker, date, ln(1 + y) - ln(1 + price) AS residual FROM staged WHERE horizon = 1 AND y IS NOT NULL)",
        "hashed AS (SELECT *, md5(concat_ws('|', ticker, CAST(date AS VARCHAR), '321|0')) AS hash FROM changes)",
        """
drawn AS (
  SELECT ticker, date, residual, row_number() OVER (ORDER BY abs(residual) DESC, md5(concat_ws('|', ticker, CAST(date AS VARCHAR), '321|0|ties'))) <= greatest(1, CAST(floor(count(*) OVER () * 0.2) AS BIGINT)) AS large,
    CAST('0x' || substr(hash, 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM hashed
)""",
    )
    + f"SELECT ticker, date, {r('residual')}, CASE WHEN large THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS weight FROM drawn WHERE large OR u < 0.1 / 0.8",
    "forecast_metrics": ctes(*TO_DENSE, f"""
pairs_of AS (
  SELECT d.ticker, h.horizon, t.price AS y, d.price AS y_hat FROM dense d CROSS JOIN (SELECT unnest(range(1, {HORIZON} + 1)) AS horizon) h
  JOIN dense t ON t.ticker = d.ticker AND t.rn = d.rn + h.horizon
)""") + f"SELECT ticker, horizon, {', '.join(r(e, 4, c) for c, e in measures().items())} FROM pairs_of GROUP BY ticker, horizon",
    "leaderboard": ctes(*TO_PERFORMANCE, BOARD)
    + f"SELECT ticker, model, {', '.join(r(c) for c in [*(f'time_gap_{h}' for h in range(1, HORIZON + 1)), 'avg', 'std', 'running_time'])} FROM board",
    "leaderboard_score": ctes(*TO_PERFORMANCE, BOARD)
    + f"SELECT ticker, model, {', '.join(r(c) for c in [*(f'time_gap_{h}' for h in range(1, HORIZON + 1)), 'avg', 'std'])} FROM board WHERE model = 'KNN'",
    "best_models": ctes(*TO_PERFORMANCE) + f"SELECT ticker, horizon, arg_min(model, (nmae, model)) AS model, {r('min(nmae)', 6, 'nmae')} FROM perf GROUP BY ticker, horizon",
    "perf_union": ctes(*TO_STAGED, *knn_parts((3, 5, 7)), KNN_TUNED, *arima_parts(), predictions("ARIMA", "KNN"), PERFORMANCE)
    + f"SELECT ticker, model, horizon, {r('mae', 5)}, {r('mape', 5)}, {r('nmae', 5)}, {r('r2', 5)} FROM perf",
    "row_concat": """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS nation FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "forecast_round": ctes(*TO_STAGED, *knn_parts((3, 5, 7)), KNN_TUNED)
    + f"SELECT ticker, horizon, {plus_days('last_day', 'horizon')} AS date, round_even(y_hat, 0) AS forecast FROM knn_tuned, request WHERE role = 'test'",
    "chart_series": ctes(*TO_DENSE, *arima_parts(), FORECASTS) + "," + chart("dense", 20, 20),
    "chart_series_tail": ctes(*TO_DENSE, *arima_parts(), FORECASTS, f"tail AS (SELECT * FROM dense WHERE rn >= n - {HORIZON})") + "," + chart("tail", 5, 5),
    "forecast_job": job(["Linear", "KNN", "ARIMA"], ALL_MODELS, HORIZON),
    "forecast_job_all": ctes(*TO_STAGED, ROLES)
    + f"""SELECT ticker, model, horizon, role, {r('y', 3)}, TRUE AS has_forecast
FROM roles, (VALUES ('Linear'), ('ElasticNet'), ('KNN'), ('XGB_GBT'), ('LGB_RandomForest'), ('LGB_GOSS'), ('ARIMA')) AS m(model)
WHERE role IN ('validation', 'test')""",
    "forecast_job_fine": job(["Linear", "KNN", "ARIMA"], FINE_PARTS, HORIZON),
    "forecast_company": job(["KNN", "ARIMA"], COMPANY_PARTS, HORIZON),
    "listing_named": f"SELECT * FROM ({CUSTOMER_LISTING}) WHERE name IN ('Customer#000000003', 'Customer#000000007')",
    "leaderboard_times": ctes(*TO_PERFORMANCE, BOARD.replace(
        "CAST(NULL AS DOUBLE) AS running_time", "CASE model WHEN 'Linear' THEN 1.5 WHEN 'KNN' THEN 2.25 ELSE 0.5 END::DOUBLE AS running_time"
    )) + f"SELECT ticker, model, {r('avg')}, running_time FROM board",
    "elasticnet_fixed": ctes(*TO_STAGED, ROLES, *fixed_net(1.0, 0.5)).replace("WITH", "WITH RECURSIVE", 1)
    + forecast_rows("net", ", 1.0::DOUBLE AS alpha, 0.5::DOUBLE AS l1_ratio"),
    "grid_linspace": f"""SELECT ticker, a * 9 + b AS grid_ord, round(0.001::DOUBLE + a * (999.999::DOUBLE / 99), 9) AS alpha, (b + 1) / 10.0::DOUBLE AS l1_ratio
FROM (SELECT DISTINCT c_mktsegment AS ticker FROM customer JOIN orders ON o_custkey = c_custkey), range(100) g(a), range(9) k(b)""",
    "company_page": f"""WITH stored AS ({STATEMENTS.replace(', 2)', ', 4)')}), {METRIC_ROWS}
SELECT company, statement AS part, label, period, value FROM stored WHERE company = (SELECT min(company) FROM stored)
UNION ALL SELECT company, 'metrics', metric, CAST(NULL AS DATE), value FROM metric_rows WHERE company = (SELECT min(company) FROM stored)""",
    "forecast_request": job(["Linear", "KNN", "ARIMA"], REQUEST_PARTS, 20),
    "stmt_long": f"""WITH stored AS ({STATEMENTS}), periods AS (SELECT DISTINCT period FROM stored),
labels AS (SELECT DISTINCT sector, company, statement, label FROM stored)
SELECT l.*, p.period, s.value FROM labels l CROSS JOIN periods p LEFT JOIN stored s USING (sector, company, statement, label, period)""",
    "stmt_roundtrip": STATEMENTS,
    "stmt_first_sector": FIRST_SECTORS,
    "stmt_nested": FIRST_SECTORS,
    "stmt_published": FIRST_SECTORS + " AND company IN (SELECT min(company) FROM sales UNION SELECT max(company) FROM sales)",
    "metrics_transpose": f"WITH {METRIC_ROWS} SELECT company, metric, value FROM metric_rows",
}
