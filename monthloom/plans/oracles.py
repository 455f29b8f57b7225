"""ANSI SQL for the registered queries, over the same tables."""

from __future__ import annotations

from monthloom.config import FEATURE_COLS, HOLT_WINTERS, LAGS, LINEAR, SEASON_MONTHS
from monthloom.plans.registered import ARMA, CONFIG, KALMAN_ARMA, NAIVE, SEASON, SMOOTHING, YEARS

LABEL = "strftime(ds, '%Y-%m') AS date_label"
Z = [f"z_{c}" for c in FEATURE_COLS]


def r(expression: str, digits: int = 6) -> str:
    """Rounded, with minus zero made zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def members(values) -> str:
    return "(" + ", ".join(map(str, values)) + ")"


def _panel(events: str) -> str:
    return f"""
    daily AS ({events}),
    monthly AS (
      SELECT series_id, ds, sum(v) AS y FROM daily
      WHERE ds < (SELECT CASE WHEN max(day) = last_day(max(day)) THEN date_trunc('month', max(day)) + INTERVAL 1 MONTH
                              ELSE date_trunc('month', max(day)) END FROM daily)
      GROUP BY series_id, ds),
    spine AS (
      SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds
      FROM monthly GROUP BY series_id),
    panel AS (
      SELECT s.series_id, s.ds, coalesce(m.y, 0) AS y,
             CAST(year(s.ds) AS INTEGER) AS year, CAST(month(s.ds) AS INTEGER) AS month
      FROM spine s LEFT JOIN monthly m ON s.series_id = m.series_id AND s.ds = m.ds)"""


def _orders_by(column: str) -> str:
    return _panel(f"""
      SELECT {column} AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
             CAST(o_orderdate AS DATE) AS day, 1 AS v
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")


PANEL = "WITH RECURSIVE" + _orders_by("n_name")
SEGMENTS = "WITH" + _orders_by("c_mktsegment")
CUSTOMERS = "WITH" + _panel("""
      SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
             CAST(o_orderdate AS DATE) AS day, 1 AS v FROM orders""")
SHIPMENTS = "WITH" + _panel("""
      SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
             CAST(l_shipdate AS DATE) AS day, l_quantity AS v FROM lineitem""")


def _season(month: str = "month") -> str:
    whens = " ".join(f"WHEN {month} IN {members(ms)} THEN '{name}'" for name, ms in SEASON_MONTHS.items())
    return f"CASE {whens} ELSE 'shoulder' END"


def _flags(month: str, anomaly: str) -> str:
    def one(name: str) -> str:
        return f"CASE WHEN {month} IN {members(SEASON_MONTHS[name])} THEN 1 ELSE 0 END"

    return f"""sin(2 * pi() * {month} / 12) AS month_sin, cos(2 * pi() * {month} / 12) AS month_cos,
             {one('spring_trek')} AS is_spring_trek, {one('autumn_trek')} AS is_autumn_trek,
             {one('monsoon')} AS is_monsoon, {anomaly} AS is_covid"""


HISTORY = PANEL + f""",
    labelled AS (SELECT *, {_season()} AS season, strftime(ds, '%b') AS month_name FROM panel),
    of_years AS (SELECT * FROM labelled WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]}),
    filtered AS (SELECT * FROM of_years WHERE season = '{SEASON}')"""

FEATURES = PANEL + f""",
    lagged AS (
      SELECT *, {_flags("month", f"CASE WHEN year IN {members(CONFIG.anomaly_years)} THEN 1 ELSE 0 END")},
             CAST(year - min(year) OVER s AS DOUBLE) / greatest(max(year) OVER s - min(year) OVER s, 1) AS year_norm,
             {", ".join(f"CAST(lag(y, {k}) OVER w AS DOUBLE) AS lag_{k}" for k in LAGS)}
      FROM panel WINDOW s AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY ds)),
    features AS (SELECT * FROM lagged WHERE {" AND ".join(f"lag_{k} IS NOT NULL" for k in LAGS)})"""

SPLIT = FEATURES + f""",
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back,
             count(*) OVER (PARTITION BY series_id) AS n_rows FROM features),
    parts AS (
      SELECT *, CASE WHEN back > {CONFIG.test_months} THEN 'train' ELSE 'test' END AS split
      FROM numbered WHERE n_rows > {CONFIG.test_months}),
    train AS (SELECT * FROM parts WHERE split = 'train'),
    test AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds) AS INTEGER) AS step
      FROM parts WHERE split = 'test')"""


def _moments(columns) -> str:
    one = "SELECT series_id, '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS sd FROM train GROUP BY series_id"
    return "(" + " UNION ALL ".join(one.format(c=c) for c in columns) + ")"


def _scaler(columns) -> str:
    std = "CASE WHEN sd = 0 THEN 1 ELSE sd END"
    return SPLIT + f"""
    SELECT series_id, "column", {r('mean')} AS mean, {r(std)} AS std FROM {_moments(columns)}"""


def _wide(columns) -> str:
    pairs = ", ".join(
        f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS std_{c}" for c in columns
    )
    scaled = ", ".join(f"({c} - mean_{c}) / std_{c} AS z_{c}" for c in columns)
    return SPLIT + f""",
    wide AS (SELECT series_id, {pairs} FROM train GROUP BY series_id),
    scaled AS (SELECT p.series_id, ds, split, y, {scaled}, mean_y, std_y FROM parts p JOIN wide USING (series_id))"""


SCALED = _wide((*FEATURE_COLS, "y"))

OLS2 = SPLIT + """,
    cov AS (
      SELECT series_id, avg(y) AS ym, avg(lag_1) AS m1, avg(lag_12) AS m2, var_pop(lag_1) AS v1, var_pop(lag_12) AS v2,
             covar_pop(lag_1, lag_12) AS v12, covar_pop(y, lag_1) AS y1, covar_pop(y, lag_12) AS y2
      FROM train GROUP BY series_id),
    slopes AS (
      SELECT *, (v2 * y1 - v12 * y2) / (v1 * v2 - v12 * v12) AS b1, (v1 * y2 - v12 * y1) / (v1 * v2 - v12 * v12) AS b2
      FROM cov),
    ols AS (SELECT series_id, ym - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM slopes)"""



def _least_squares() -> str:
    """Slopes of all scaled regressors: elimination on the matrix of mean products, one column per step."""
    rows = ", ".join("[" + ", ".join(f"avg({a} * {b})" for b in (*Z, "z_y")) + "]" for a in Z)
    k = len(Z)
    return f""",
    products AS (SELECT series_id, [{rows}] AS m FROM scaled WHERE split = 'train' GROUP BY series_id),
    elimination AS (
      SELECT series_id, m, 0 AS k FROM products
      UNION ALL
      SELECT series_id, list_transform(range(1, {k + 1}), lambda i:
               CASE WHEN i = k + 1 THEN list_transform(m[i], lambda v: v / m[k + 1][k + 1])
                    ELSE list_transform(range(1, {k + 2}), lambda c: m[i][c] - m[i][k + 1] * m[k + 1][c] / m[k + 1][k + 1])
               END), k + 1
      FROM elimination WHERE k < {k}),
    slopes10 AS (SELECT series_id, list_transform(m, lambda line: line[{k + 1}]) AS b FROM elimination WHERE k = {k})"""


_TERMS = " + ".join(f"b[{i + 1}] * {c}" for i, c in enumerate(Z))

FUTURE = f""",
    future_arr AS (
      SELECT series_id, list(CAST(y AS DOUBLE) ORDER BY ds) AS ys, max(ds) AS last, min(year) AS lo, max(year) AS hi,
             count(*) AS n FROM features GROUP BY series_id),
    future_steps AS (SELECT *, CAST(unnest(range(1, 13)) AS INTEGER) AS step FROM future_arr),
    future_dates AS (SELECT *, CAST(last + to_months(step) AS DATE) AS ds FROM future_steps),
    future AS (
      SELECT *, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, {_flags("month(ds)", "0")},
             CAST(year(ds) - lo AS DOUBLE) / greatest(greatest(hi, year(ds)) - lo, 1) AS year_norm,
             {", ".join(f"CASE WHEN n + step - {k} < 1 THEN 0 ELSE ys[least(n, n + step - {k})] END AS lag_{k}" for k in LAGS)}
      FROM future_dates)"""


def _smoothing(source: str) -> str:
    a, b, g = SMOOTHING
    level = f"({a} * (ys[t + 1] - s[1]) + {1 - a} * (l + b))"
    miss = "(ys[t + 1] - l - b - s[1])"
    return f""",
    arr AS (SELECT series_id, list(CAST(y AS DOUBLE) ORDER BY ds) AS ys, max(ds) AS last FROM {source} GROUP BY series_id),
    started AS (SELECT *, list_avg(ys[1:12]) AS first, list_avg(ys[13:24]) AS second FROM arr WHERE len(ys) >= 24),
    hw AS (
      SELECT series_id, ys, last, 0 AS t, first AS l, (second - first) / 12 AS b,
             list_transform(ys[1:12], lambda v: v - first) AS s, CAST(0 AS DOUBLE) AS sse FROM started
      UNION ALL
      SELECT series_id, ys, last, t + 1, {level}, {b} * ({level} - l) + {1 - b} * b,
             list_append(s[2:12], {g} * (ys[t + 1] - l - b) + {1 - g} * s[1]), sse + {miss} * {miss}
      FROM hw WHERE t < len(ys)),
    hw_end AS (SELECT * FROM hw WHERE t = len(ys))"""


HW_FORECAST = """
      SELECT series_id, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, step,
             l + step * b + s[(step - 1) % 12 + 1] AS yhat
      FROM (SELECT *, unnest(range(1, 13)) AS step FROM hw_end)"""

FORECASTS = OLS2 + _smoothing("train") + f""",
    forecasts AS (
      SELECT series_id, '{NAIVE}' AS model, ds, step, lag_12 AS yhat FROM test
      UNION ALL SELECT series_id, '{HOLT_WINTERS}', ds, CAST(step AS INTEGER), yhat FROM ({HW_FORECAST})
      UNION ALL SELECT series_id, '{LINEAR}', ds, step, b0 + b1 * lag_1 + b2 * lag_12
                FROM test JOIN ols USING (series_id)),
    metrics AS (
      SELECT f.series_id, model, {r('avg(abs(y - yhat))', 2)} AS mae, {r('sqrt(avg((y - yhat) * (y - yhat)))', 2)} AS rmse,
             {r('avg(abs((y - yhat) / y)) FILTER (WHERE y <> 0) * 100', 2)} AS mape
      FROM forecasts f JOIN test t ON f.series_id = t.series_id AND f.ds = t.ds GROUP BY f.series_id, model)"""

_AR, _SAR, _MA, _SMA = ARMA


def _lag(name: str, k: int) -> str:
    return f"{name}[t + {14 - k}]"


SARMA = PANEL + f""",
    diffs AS (
      SELECT series_id, ds, CAST(y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w AS DOUBLE) AS dy
      FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
    known AS (
      SELECT series_id, list(dy ORDER BY ds) AS ws, list(ds ORDER BY ds) AS dates FROM diffs
      WHERE dy IS NOT NULL GROUP BY series_id),
    padded AS (SELECT series_id, dates, list_concat([CAST(0 AS DOUBLE) FOR _ IN range(13)], ws) AS w, len(ws) AS n FROM known),
    path AS (
      SELECT series_id, dates, w, n, 0 AS t, [CAST(0 AS DOUBLE) FOR _ IN range(13)] AS e FROM padded
      UNION ALL
      SELECT series_id, dates, w, n, t + 1, list_append(e,
        w[t + 14] - ({_AR} * {_lag('w', 1)} + {_SAR} * {_lag('w', 12)} - {_AR} * {_SAR} * {_lag('w', 13)}
                     + ({_MA}) * {_lag('e', 1)} + ({_SMA}) * {_lag('e', 12)} + ({_MA}) * ({_SMA}) * {_lag('e', 13)}))
      FROM path WHERE t < n),
    done AS (SELECT series_id, unnest(dates) AS ds, unnest(e[14:]) AS error FROM path WHERE t = n)"""

_PHI, _THETA = KALMAN_ARMA

# The Kalman filter of an ARMA(1,1) with state (x_t, θ e_t), started from its stationary covariance, one month per step:
# after an observation the first state is known, so only the second's variance is carried on.
KALMAN = PANEL + f""",
    diffs AS (
      SELECT series_id, ds, CAST(y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w AS DOUBLE) AS dy
      FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
    known AS (SELECT series_id, list(dy ORDER BY ds) AS ws FROM diffs WHERE dy IS NOT NULL GROUP BY series_id),
    kal AS (
      SELECT series_id, ws, len(ws) AS n, 1 AS t, CAST(0 AS DOUBLE) AS a0, CAST(0 AS DOUBLE) AS a1,
             (1 + 2 * {_PHI} * ({_THETA}) + ({_THETA}) * ({_THETA})) / (1 - {_PHI} * {_PHI}) AS p00,
             CAST({_THETA} AS DOUBLE) AS p01, ({_THETA}) * ({_THETA}) AS p11, CAST(0 AS DOUBLE) AS sq, CAST(0 AS DOUBLE) AS lf
      FROM known
      UNION ALL
      SELECT series_id, ws, n, t + 1, {_PHI} * ws[t] + a1 + p01 / p00 * (ws[t] - a0), CAST(0 AS DOUBLE),
             p11 - p01 * p01 / p00 + 1, {_THETA}, ({_THETA}) * ({_THETA}),
             sq + (ws[t] - a0) * (ws[t] - a0) / p00, lf + ln(p00)
      FROM kal WHERE t <= n),
    ends AS (SELECT series_id, n, sq / n AS s2, lf FROM kal WHERE t = n + 1)"""


def _network(sizes: tuple[int, ...]) -> str:
    """Outputs of each layer ``h<k>`` per row and unit, by the formula of the registered network."""
    inputs = " UNION ALL ".join(f"SELECT series_id, ds, {i} AS i, {c} AS v FROM scaled" for i, c in enumerate(Z))
    parts = [f",\n    h0 AS ({inputs})"]
    for layer, (a, b) in enumerate(zip(sizes, sizes[1:])):
        weight = f"sin(0.7 * i + 1.3 * j + {layer}) * sqrt(CAST(2 AS DOUBLE) / {a})"
        total = f"sum(v * {weight}) + 0.1 * cos(j + {layer})"
        value = total if layer == len(sizes) - 2 else f"greatest(CAST(0 AS DOUBLE), {total})"
        parts.append(f"""h{layer + 1} AS (
      SELECT series_id, ds, j AS i, {value} AS v
      FROM h{layer} JOIN (SELECT CAST(unnest(range({b})) AS INTEGER) AS j) ON true GROUP BY series_id, ds, j)""")
    return ",\n    ".join(parts)


MLP = SCALED + _network((10, 64, 32, 1))

GRADIENT = SCALED.replace("FROM parts p JOIN wide", "FROM train p JOIN wide") + _network((10, 4, 1)) + """,
    miss AS (
      SELECT series_id, ds, 2 * (v - z_y) / (SELECT count(*) FROM scaled) AS d FROM h2 JOIN scaled USING (series_id, ds)),
    back AS (
      SELECT series_id, ds, i AS j, v AS h, d,
             CASE WHEN v > 0 THEN d * sin(0.7 * i + 1) * sqrt(CAST(2 AS DOUBLE) / 4) ELSE 0 END AS dz
      FROM h1 JOIN miss USING (series_id, ds)),
    terms AS (
      SELECT x.i * 4 + j AS pos, sum(x.v * dz) AS gradient FROM back JOIN h0 x USING (series_id, ds) GROUP BY x.i, j
      UNION ALL SELECT 40 + j, sum(dz) FROM back GROUP BY j
      UNION ALL SELECT 44 + j, sum(h * d) FROM back GROUP BY j
      UNION ALL SELECT 48, sum(d) FROM miss)"""

_PANEL_ROWS = f"SELECT series_id, {LABEL}, CAST(y AS BIGINT) AS y, year, month FROM panel"
_COUNT = "CAST(greatest(0, round_even(CAST({v} AS DOUBLE), 0)) AS BIGINT)"
_HALF_UP = "CAST(floor({v} + 0.5) AS BIGINT)"


def _feature_columns() -> str:
    doubles = {"month_sin", "month_cos", "year_norm", *(f"lag_{k}" for k in LAGS)}
    return ", ".join(f"{r(c)} AS {c}" if c in doubles else c for c in FEATURE_COLS)


ORACLES: dict[str, str] = {
    "monthly_panel": f"{PANEL} {_PANEL_ROWS}",
    "segment_panel": f"{SEGMENTS} {_PANEL_ROWS}",
    "shipment_panel": f"{SHIPMENTS} SELECT series_id, {LABEL}, y, year, month FROM panel",
    "short_series": f"""{CUSTOMERS}
      SELECT series_id, count(*) AS n_months FROM panel GROUP BY series_id
      HAVING count(*) <= {max(LAGS) + CONFIG.test_months}""",
    "history_records": f"""{HISTORY}
      SELECT series_id, strftime(ds, '%Y-%m') AS date, year, month, month_name, season, CAST(y AS BIGINT) AS arrivals
      FROM filtered""",
    "monthly_average": f"""{HISTORY}
      SELECT series_id, month, month_name, {r('avg(y)', 2)} AS average_arrivals FROM filtered
      GROUP BY series_id, month, month_name""",
    "season_average": f"""{HISTORY}
      SELECT series_id, season, {r('avg(y)', 2)} AS average_arrivals FROM of_years GROUP BY series_id, season""",
    "history_meta": f"""{HISTORY}
      SELECT series_id, {YEARS[0]} AS start_year, {YEARS[1]} AS end_year, '{SEASON}' AS season,
             count(*) FILTER (WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]} AND season = '{SEASON}') AS records,
             min(year) AS min_year, max(year) AS max_year
      FROM labelled GROUP BY series_id""",
    "history_summary": f"""{HISTORY},
      selected AS (
        SELECT series_id, {_HALF_UP.format(v='coalesce(avg(coalesce(y, 0)), 0)')} AS average_selected,
               strftime(max(ds), '%Y-%m') AS latest_month, CAST(arg_max(y, ds) AS BIGINT) AS latest_value
        FROM filtered GROUP BY series_id),
      seasons AS (SELECT series_id, season, avg(y) AS average FROM of_years GROUP BY series_id, season),
      ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY average DESC, season) AS INTEGER) AS season_rank
        FROM seasons)
      SELECT series_id, average_selected, latest_month, latest_value, season_rank, season,
             {_HALF_UP.format(v='average')} AS season_average
      FROM selected JOIN ranked USING (series_id) WHERE season_rank <= 4""",
    "features": f"""{FEATURES}
      SELECT series_id, {LABEL}, CAST(y AS BIGINT) AS y, year, month, {_feature_columns()} FROM features""",
    "train_test_split": f"{SPLIT} SELECT series_id, {LABEL}, split, CAST(y AS BIGINT) AS y FROM parts",
    "seasonal_difference": f"{SARMA} SELECT series_id, {LABEL}, dy FROM diffs WHERE dy IS NOT NULL",
    "feature_scaler": _scaler(FEATURE_COLS),
    "target_scaler": _scaler(("y",)),
    "zscore_transform": f"""{SCALED}
      SELECT series_id, {LABEL}, split, {", ".join(f"{r(c)} AS {c}" for c in (*Z, "z_y"))} FROM scaled""",
    "zscore_roundtrip": f"""{SCALED}
      SELECT series_id, {LABEL}, {r('z_lag_12')} AS z_lag_12, {r('z_y')} AS z_y, {r('z_y * std_y + mean_y')} AS y_back
      FROM scaled""",
    "ols_fit2": f"""{OLS2}
      SELECT series_id, 'ok' AS status, {r('b0')} AS intercept, {r('b1')} AS lag_1, {r('b2')} AS lag_12 FROM ols""",
    "ols_coefficients": f"""{OLS2},
      listed AS (
        SELECT series_id, 0 AS position, 'intercept' AS feature, b0 AS c FROM ols
        UNION ALL SELECT series_id, 1, 'lag_1', b1 FROM ols UNION ALL SELECT series_id, 2, 'lag_12', b2 FROM ols)
      SELECT series_id, position, feature, {r('c')} AS coefficient, CASE WHEN c >= 0 THEN '+' ELSE '-' END AS sign
      FROM listed""",
    "ols_predict2": f"""{OLS2}
      SELECT series_id, {LABEL}, step, {r('b0 + b1 * lag_1 + b2 * lag_12')} AS yhat FROM test JOIN ols USING (series_id)""",
    "future_features": f"""{FEATURES}{FUTURE}
      SELECT series_id, step, {LABEL}, year, month, {_feature_columns()} FROM future""",
    "ols_fit": f"""{SCALED}{_least_squares()},
      listed AS (SELECT series_id, unnest(range(1, 11)) AS p, b, {list(FEATURE_COLS)} AS names FROM slopes10)
      SELECT series_id, CAST(p AS INTEGER) AS position, names[p] AS feature, {r('b[p]')} AS coefficient,
             CASE WHEN b[p] >= 0 THEN '+' ELSE '-' END AS sign
      FROM listed""",
    "ols_pooled": f"""{SCALED},
      cov AS (
        SELECT var_pop(z_lag_1) AS v1, var_pop(z_lag_12) AS v2, covar_pop(z_lag_1, z_lag_12) AS v12,
               covar_pop(z_y, z_lag_1) AS y1, covar_pop(z_y, z_lag_12) AS y2 FROM scaled WHERE split = 'train'),
      listed AS (
        SELECT 1 AS position, 'lag_1' AS feature, (v2 * y1 - v12 * y2) / (v1 * v2 - v12 * v12) AS c FROM cov
        UNION ALL SELECT 2, 'lag_12', (v1 * y2 - v12 * y1) / (v1 * v2 - v12 * v12) FROM cov)
      SELECT 'pooled' AS series_id, position, feature, {r('c')} AS coefficient, CASE WHEN c >= 0 THEN '+' ELSE '-' END AS sign
      FROM listed""",
    "ols_backtest": f"""{SCALED}{_least_squares()},
      fitted AS (
        SELECT series_id, y, ({_TERMS}) * std_y + mean_y AS yhat FROM scaled JOIN slopes10 USING (series_id)
        WHERE split = 'test')
      SELECT series_id, '{LINEAR}' AS model, {r('avg(abs(y - yhat))', 2)} AS mae,
             {r('sqrt(avg((y - yhat) * (y - yhat)))', 2)} AS rmse,
             {r('avg(abs((y - yhat) / y)) FILTER (WHERE y <> 0) * 100', 2)} AS mape
      FROM fitted GROUP BY series_id""",
    "ols_forecast": f"""{SCALED}{_least_squares()}{FUTURE},
      scaled_future AS (
        SELECT f.series_id, step, ds, std_y, mean_y,
               {", ".join(f"(f.{c} - mean_{c}) / std_{c} AS z_{c}" for c in FEATURE_COLS)}
        FROM future f JOIN wide USING (series_id))
      SELECT series_id, step, {LABEL}, {_COUNT.format(v=f"({_TERMS}) * std_y + mean_y")} AS yhat
      FROM scaled_future JOIN slopes10 USING (series_id)""",
    "forecast_post": f"""{FEATURES}
      SELECT series_id, {LABEL}, {_COUNT.format(v='(y - lag_12) / 2')} AS "count" FROM features""",
    "hw_forecast_fixed": f"""{SPLIT}{_smoothing("train")}
      SELECT series_id, {LABEL}, CAST(step AS INTEGER) AS step, {r('yhat')} AS yhat FROM ({HW_FORECAST})""",
    "hw_state_fixed": f"""{PANEL}{_smoothing("panel")}
      SELECT series_id, {r('l')} AS level, {r('b')} AS trend, {r('sse')} AS sse FROM hw_end""",
    "ols_raw": f"""{PANEL}
      SELECT series_id, 'ok' AS status, round(regr_intercept(y, x), 2) AS intercept, round(regr_slope(y, x) * 31557600, 4) AS slope_per_year
      FROM (SELECT series_id, CAST(y AS DOUBLE) AS y, CAST(date_diff('day', DATE '1970-01-01', ds) AS DOUBLE) * 86400 AS x FROM panel)
      GROUP BY series_id""",
    "arma_likelihood_fixed": f"""{KALMAN}
      SELECT series_id, n, {r('ln(s2)')} AS log_sigma2, {r('-0.5 * (n * ln(2 * pi() * s2) + lf + n)')} AS loglike FROM ends""",
    "sarma_filter_fixed": f"{SARMA} SELECT series_id, {LABEL}, {r('error')} AS error FROM done",
    "mlp_forward": f"{MLP} SELECT series_id, {LABEL}, {r('v')} AS yhat FROM h3",
    "mlp_forward_batched": f"{MLP} SELECT series_id, {LABEL}, {r('v')} AS yhat FROM h3",
    "mlp_loss": f"""{MLP}
      SELECT series_id, split, {r('avg((v - z_y) * (v - z_y))')} AS mse FROM h3 JOIN scaled USING (series_id, ds)
      GROUP BY series_id, split""",
    "mlp_gradient": f"{GRADIENT} SELECT CAST(pos AS INTEGER) AS pos, {r('gradient')} AS gradient FROM terms",
    "forecast_union": f"{FORECASTS} SELECT series_id, model, {LABEL}, step, {r('yhat')} AS yhat FROM forecasts",
    "forecast_metrics": f"{FORECASTS} SELECT series_id, model, mae, rmse, mape FROM metrics",
    "metrics_roundtrip": f"{FORECASTS} SELECT series_id, model, mae, rmse, mape FROM metrics",
    "unpaired_months": f"""{SPLIT},
      kept AS (SELECT series_id, ds FROM test),
      shown AS (SELECT series_id, CAST(ds + INTERVAL 3 MONTH AS DATE) AS ds FROM test)
      SELECT series_id, {LABEL}, '{NAIVE}' AS model, 'forecast' AS has_only
      FROM shown ANTI JOIN kept USING (series_id, ds)
      UNION ALL
      SELECT series_id, {LABEL}, NULL, 'actual' FROM kept ANTI JOIN shown USING (series_id, ds)""",
    "seasonal_naive_metrics": f"""{FORECASTS}
      SELECT series_id, model, mae, rmse, mape FROM metrics WHERE model = '{NAIVE}'""",
    "leaderboard": f"""{FORECASTS}
      SELECT series_id, model, {_HALF_UP.format(v='mae')} AS mae, {_HALF_UP.format(v='rmse')} AS rmse, mape,
             CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY mape NULLS LAST, model) = 1
                  THEN 'Best' ELSE 'Baseline' END AS status
      FROM metrics""",
    "forecast_summary": f"""{FORECASTS},
      counts AS (SELECT series_id, model, step, {_COUNT.format(v='yhat')} AS c FROM forecasts)
      SELECT series_id, model, arg_min(c, step) AS next_value, CAST(sum(c) AS BIGINT) AS total_forecast
      FROM counts WHERE model = '{HOLT_WINTERS}' GROUP BY series_id, model""",
}
