"""Forecasts, rollouts, ensembles and backtests over all routes and origins.

The test tables rarely hold a full week without an empty hour, so jobs run twice: strictly, where
the baseline answers for the sequence models, and with ``min_history=120``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.catalog.registry import query, rd, sql, table
from lanewise.operators import resample, windows
from lanewise.plans import backtest
from lanewise.plans import forecast as fc
from lanewise.plans import pooled

RELAXED = 120
# The models that the jobs below compare; the regression has queries of its own.
COMPARED = tuple(m for m in fc.MODELS if m != "linear")

table("days_all", """
SELECT RouteId, unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS origin,
       first, last FROM spans
""", "spans")
table("origins", "SELECT RouteId, origin FROM days_all WHERE origin > first AND origin < last", "days_all")
table("stats", """
SELECT o.RouteId, o.origin, avg(h.Vehicles) AS m, count(h.Vehicles) AS n_history
FROM days_all o LEFT JOIN hourly h
  ON h.RouteId = o.RouteId AND h.DateTime >= o.origin - INTERVAL 168 HOUR AND h.DateTime < o.origin
GROUP BY 1, 2
""", "days_all", "hourly")
table("targets", """
SELECT o.RouteId, o.origin, CAST(k AS INTEGER) AS step, o.origin + to_hours(CAST(k AS INTEGER)) AS DateTime
FROM days_all o, (SELECT unnest(range(24)) AS k)
""", "days_all")

# Every origin gets its own series: cut at the origin, completed and filled.
table("cut", """
SELECT o.RouteId, o.origin, h.DateTime, h.Vehicles
FROM days_all o JOIN hourly h ON h.RouteId = o.RouteId AND h.DateTime < o.origin
""", "days_all", "hourly")
table("cut_grid", """
SELECT g.RouteId, g.origin, g.DateTime, c.Vehicles,
       row_number() OVER (PARTITION BY g.RouteId, g.origin ORDER BY g.DateTime) AS pos
FROM (SELECT RouteId, origin, unnest(generate_series(min(DateTime), max(DateTime), INTERVAL 1 HOUR)) AS DateTime
      FROM cut GROUP BY 1, 2) g
LEFT JOIN cut c USING (RouteId, origin, DateTime)
""", "cut")
table("cut_filled", """
SELECT RouteId, origin, DateTime, CASE WHEN Vehicles IS NOT NULL THEN Vehicles
       ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END AS v
FROM (SELECT *,
    last_value(Vehicles IGNORE NULLS) OVER back AS pv,
    last_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pp,
    first_value(Vehicles IGNORE NULLS) OVER ahead AS nv,
    first_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np
  FROM cut_grid
  WINDOW back AS (PARTITION BY RouteId, origin ORDER BY DateTime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY RouteId, origin ORDER BY DateTime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""", "cut_grid")
# The same without cutting first: filled once, then cut.
table("leak_filled", """
SELECT o.RouteId, o.origin, f.DateTime, f.Vehicles AS v
FROM days_all o JOIN filled f ON f.RouteId = o.RouteId AND f.DateTime < o.origin
""", "days_all", "filled")


def _fit(name: str, source: str, season: int) -> None:
    level = "v" if not season else f"v - lag(v, {season}) OVER w"
    table(name, f"""
SELECT RouteId, origin, phi, c / (1 - phi) AS mu, last_time, last_level
FROM (SELECT RouteId, origin, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, count(*) AS n,
             max(DateTime) AS last_time, arg_max(y, DateTime) AS last_level
      FROM (SELECT *, lag(y) OVER w AS x
            FROM (SELECT RouteId, origin, DateTime, {level} AS y FROM {source}
                  WINDOW w AS (PARTITION BY RouteId, origin ORDER BY DateTime))
            WINDOW w AS (PARTITION BY RouteId, origin ORDER BY DateTime))
      GROUP BY 1, 2)
WHERE abs(phi) < 1 AND n >= 24
""", source)


_fit("ar1_fit", "cut_filled", 0)
_fit("sar1_fit", "cut_filled", 24)
_fit("ar1_leak_fit", "leak_filled", 0)


def _ar_pred(fit: str) -> str:
    return f"""
SELECT t.RouteId, t.origin, t.DateTime,
       f.mu + pow(f.phi, date_diff('hour', f.last_time, t.DateTime)) * (f.last_level - f.mu) AS v
FROM targets t JOIN {fit} f USING (RouteId, origin)
"""


table("p_seasonal_naive", """
SELECT t.RouteId, t.origin, t.DateTime, h.Vehicles AS v
FROM targets t JOIN hourly h ON h.RouteId = t.RouteId AND h.DateTime = t.DateTime - INTERVAL 168 HOUR
""", "targets", "hourly")
table("p_daily_naive", """
SELECT t.RouteId, t.origin, t.DateTime, h.Vehicles AS v
FROM targets t JOIN hourly h ON h.RouteId = t.RouteId AND h.DateTime = t.DateTime - INTERVAL 24 HOUR
""", "targets", "hourly")
table("p_profile", """
SELECT t.RouteId, t.origin, t.DateTime, avg(h.Vehicles) AS v
FROM targets t JOIN hourly h ON h.RouteId = t.RouteId AND isodow(h.DateTime) = isodow(t.DateTime)
     AND hour(h.DateTime) = hour(t.DateTime) AND h.DateTime < t.origin
GROUP BY 1, 2, 3
""", "targets", "hourly")
table("p_ar1", _ar_pred("ar1_fit"), "targets", "ar1_fit")
table("p_ar1_leak", _ar_pred("ar1_leak_fit"), "targets", "ar1_leak_fit")
table("p_sar1", """
SELECT t.RouteId, t.origin, t.DateTime,
       b.v + list_sum([t.mu + pow(t.phi, t.s - 24 * j) * (t.last_level - t.mu) FOR j IN range(t.k)]) AS v
FROM (SELECT t.*, f.mu, f.phi, f.last_level, date_diff('hour', f.last_time, t.DateTime) AS s,
             CAST(ceil(date_diff('hour', f.last_time, t.DateTime) / 24) AS BIGINT) AS k
      FROM targets t JOIN sar1_fit f USING (RouteId, origin)) t
JOIN cut_filled b ON b.RouteId = t.RouteId AND b.origin = t.origin
     AND b.DateTime = t.DateTime - to_hours(CAST(24 * t.k AS INTEGER))
""", "targets", "sar1_fit", "cut_filled")


def _forecast_sql(models, min_history, origins="origins", known="true", suffix=""):
    """All models over the given origins, as a subquery, and the tables it needs."""
    parts = []
    for m in models:
        enough = "true" if m in fc.FITTED else f"(coalesce(s.n_history, 0) >= {min_history} AND {known})"
        parts.append(f"""
SELECT t.RouteId, t.origin, t.DateTime, t.step, '{m}' AS model,
       CASE WHEN {enough} AND p.v IS NOT NULL THEN greatest(p.v, 0) ELSE coalesce(s.m, 0) END AS PredictedVehicles,
       CASE WHEN {enough} AND p.v IS NOT NULL THEN '{m}' ELSE 'baseline' END AS model_used,
       coalesce(s.n_history, 0) AS n_history
FROM targets t SEMI JOIN {origins} o ON o.RouteId = t.RouteId AND o.origin = t.origin
LEFT JOIN p_{m}{suffix} p ON p.RouteId = t.RouteId AND p.origin = t.origin AND p.DateTime = t.DateTime
LEFT JOIN stats s ON s.RouteId = t.RouteId AND s.origin = t.origin""")
    return " UNION ALL ".join(parts), ["targets", "stats", origins, *[f"p_{m}{suffix}" for m in models]]


_COLUMNS = f"RouteId, origin, DateTime, step, model, {rd('PredictedVehicles', 'PredictedVehicles')}, model_used, n_history"


def _oracle(models, min_history=168, origins="origins", known="true", suffix=""):
    body, needs = _forecast_sql(models, min_history, origins, known, suffix)
    return sql(f"SELECT {_COLUMNS} FROM ({body})", *needs)


def _origins(hourly):
    return windows.evaluation_days(hourly, 365)


def _run(spark, sf, models, **options):
    hourly = t.hourly(spark, sf)
    return fc.forecast(hourly, _origins(hourly), models, **options)


@query("fc_01_baseline_mean", sql(f"""
SELECT t.RouteId, t.origin, t.DateTime, {rd('coalesce(s.m, 0)', 'PredictedVehicles')}, 'baseline' AS model_used
FROM targets t LEFT JOIN stats s USING (RouteId, origin)
""", "targets", "stats"))
def fc_01(spark, sf):
    """Every day of the series; the first one has no history and gives 0."""
    hourly = t.hourly(spark, sf)
    return fc.baseline_mean(hourly, windows.evaluation_days(hourly, 365, include_last=True))


table("one_day", "SELECT DISTINCT RouteId, TIMESTAMP '2024-01-20' AS origin FROM obs", "obs")


@query("fc_02_forecast_day_strict", _oracle(["seasonal_naive"], 168, "one_day"))
def fc_02(spark, sf):
    return fc.forecast_day(t.hourly(spark, sf), "2024-01-20")


@query("fc_02_forecast_day_unknown_route", _oracle(["daily_naive"], 24, "one_day", "t.RouteId <> 'view'"))
def fc_02_unknown(spark, sf):
    hourly = t.hourly(spark, sf)
    known = hourly.select("RouteId").distinct().where("RouteId <> 'view'")
    return fc.forecast_day(hourly, "2024-01-20", "daily_naive", min_history=24, known_routes=known)


@query("fc_02_forecast_after_gap_fill", sql(f"""
SELECT o.RouteId, o.origin, o.origin + to_hours(CAST(k AS INTEGER)) AS DateTime, CAST(k AS INTEGER) AS step,
       'seasonal_naive' AS model, {rd('f.Vehicles', 'PredictedVehicles')}, 'seasonal_naive' AS model_used,
       CAST(168 AS BIGINT) AS n_history
FROM one_day o JOIN (SELECT unnest(range(24)) AS k) ON true
JOIN filled f ON f.RouteId = o.RouteId AND f.DateTime = o.origin + to_hours(CAST(k AS INTEGER)) - INTERVAL 168 HOUR
""", "one_day", "filled"))
def fc_02_filled(spark, sf):
    """After gap filling the strict rule is met and the model itself answers."""
    filled = resample.fill_hourly(t.hourly(spark, sf), "both")
    return fc.forecast_day(filled, "2024-01-20")


_BATCH = """
SELECT t.DateTime, t.RouteId, t.BaseDate, t.step,
       CASE WHEN t.seen >= 168 AND v.Vehicles IS NOT NULL THEN greatest(v.Vehicles, 0) ELSE coalesce(m.m, 0) END AS p,
       CASE WHEN t.seen >= 168 AND v.Vehicles IS NOT NULL THEN 'seasonal_naive' ELSE 'baseline' END AS ModelUsed
FROM (SELECT r.RouteId, d.day AS BaseDate, CAST(d.day AS TIMESTAMP) + to_hours(CAST(k AS INTEGER)) AS DateTime, k AS step,
             (SELECT count(*) FROM hourly h WHERE h.RouteId = r.RouteId AND h.DateTime < CAST(d.day AS TIMESTAMP)) AS seen
      FROM spans r, (SELECT DISTINCT CAST(DateTime AS DATE) AS day FROM obs) d, (SELECT unnest(range(24)) AS k)
      WHERE d.day >= r.first) t
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) AS pos FROM hourly) v
  ON v.RouteId = t.RouteId AND v.pos = t.seen - 168 + t.step + 1
LEFT JOIN (SELECT RouteId, pos, avg(Vehicles) OVER (PARTITION BY RouteId ORDER BY pos ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS m
           FROM (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) AS pos FROM hourly)) m
  ON m.RouteId = t.RouteId AND m.pos = t.seen
"""


@query("fc_03_batch_forecast", sql(f"""
SELECT DateTime, RouteId, {rd('p', 'PredictedVehicles')}, BaseDate, ModelUsed FROM ({_BATCH})
""", "hourly", "spans"))
def fc_03(spark, sf):
    return fc.batch_forecast(t.obs(spark, sf))


def _fitted_batch(model):
    """The batch's SQL with a model's own answers in place of the rows of the week before."""
    rows = "LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) AS pos FROM hourly) v\n"
    rows += "  ON v.RouteId = t.RouteId AND v.pos = t.seen - 168 + t.step + 1"
    own = f"LEFT JOIN p_{model} v ON v.RouteId = t.RouteId AND v.origin = t.BaseDate AND v.DateTime = t.DateTime"
    body = _BATCH.replace(rows, own).replace("v.Vehicles", "v.v").replace("'seasonal_naive'", f"'{model}'")
    return sql(f"""
SELECT DateTime, RouteId, {rd('p', 'PredictedVehicles')}, BaseDate, ModelUsed FROM ({body})
""", "hourly", "spans", f"p_{model}")


@query("fc_03_batch_ar1", _fitted_batch("ar1"))
def fc_03_ar1(spark, sf):
    return fc.batch_forecast(t.obs(spark, sf), model="ar1")


@query("fc_03_batch_sar1", _fitted_batch("sar1"))
def fc_03_sar1(spark, sf):
    return fc.batch_forecast(t.obs(spark, sf), model="sar1")


@query("fc_04_seasonal_and_profile", _oracle(["seasonal_naive", "daily_naive", "profile"], RELAXED))
def fc_04(spark, sf):
    return _run(spark, sf, ["seasonal_naive", "daily_naive", "profile"], min_history=RELAXED)


@query("fc_04_seasonal_strict", _oracle(["seasonal_naive", "profile"]))
def fc_04_strict(spark, sf):
    return _run(spark, sf, ["seasonal_naive", "profile"])


@query("fc_05_ar1", _oracle(["ar1"]))
def fc_05(spark, sf):
    return _run(spark, sf, ["ar1"])


@query("fc_05_ar1_filled_before_cut", _oracle(["ar1"], suffix="_leak"))
def fc_05_leak(spark, sf):
    return _run(spark, sf, ["ar1"], fill_first=True)


@query("fc_05_ar1_fit", sql(f"""
SELECT RouteId, origin, {rd('phi', 'phi')}, {rd('mu', 'mu')}, last_time, {rd('last_level', 'last_level')}
FROM ar1_fit SEMI JOIN origins USING (RouteId, origin)
""", "ar1_fit", "origins"))
def fc_05_fit(spark, sf):
    hourly = t.hourly(spark, sf)
    return fc.fit_ar(hourly, _origins(hourly)).select("RouteId", "origin", "ar1.*").where(
        "phi IS NOT NULL"
    )


@query("fc_06_sar1", _oracle(["sar1"]))
def fc_06(spark, sf):
    return _run(spark, sf, ["sar1"])


@query("fc_07_linear_samples", sql(f"""
SELECT t.RouteId, t.origin, t.DateTime, {rd('a.Vehicles', 'Actual')}, {rd('w.Vehicles', 'seasonal_naive')},
       {rd('d.Vehicles', 'daily_naive')}, {rd('s.m', 'history_mean')}, {rd('l.Vehicles', 'last_value')},
       CAST(r.i AS INTEGER) AS route_index, CASE WHEN s.p < floor(s.n * 0.8e0) THEN 'train' ELSE 'test' END AS split
FROM targets t
JOIN (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY origin) - 1 AS p, count(*) OVER (PARTITION BY RouteId) AS n
      FROM stats s WHERE n_history >= {RELAXED}
        AND EXISTS (SELECT 1 FROM hourly h WHERE h.RouteId = s.RouteId AND date_trunc('day', h.DateTime) = s.origin)) s USING (RouteId, origin)
JOIN hourly a ON a.RouteId = t.RouteId AND a.DateTime = t.DateTime
JOIN hourly w ON w.RouteId = t.RouteId AND w.DateTime = t.DateTime - INTERVAL 168 HOUR
JOIN hourly d ON d.RouteId = t.RouteId AND d.DateTime = t.DateTime - INTERVAL 24 HOUR
JOIN hourly l ON l.RouteId = t.RouteId AND l.DateTime = t.origin - INTERVAL 1 HOUR
JOIN (SELECT RouteId, row_number() OVER (ORDER BY RouteId) - 1 AS i FROM (SELECT DISTINCT RouteId FROM obs)) r ON r.RouteId = t.RouteId
""", "targets", "stats", "hourly"))
def fc_07_samples(spark, sf):
    return backtest.linear_samples(t.obs(spark, sf), min_history=RELAXED).select(
        "RouteId", "origin", "DateTime", "Actual", "seasonal_naive", "daily_naive",
        "history_mean", "last_value", "route_index", "split",
    )


@query("fc_07_linear_direct")
def fc_07(spark, sf):
    """Pooled regression; an iterative solver's result has no SQL form."""
    return backtest.linear_direct(t.obs(spark, sf), min_history=RELAXED)


def _scores_sql(models, min_history):
    body, needs = _forecast_sql(models, min_history)
    return f"""
SELECT RouteId, CAST(origin AS DATE) AS date, model, count(*) AS n, avg((a - p) ** 2) AS mse, sqrt(avg((a - p) ** 2)) AS rmse,
       avg(abs(a - p)) AS mae, avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END) * 100 AS mape,
       avg(2 * abs(p - a) / CASE WHEN abs(a) + abs(p) = 0 THEN 1 ELSE abs(a) + abs(p) END) * 100 AS smape,
       CASE WHEN var_pop(a) <> 0 THEN 1 - sum((a - p) ** 2) / (count(*) * var_pop(a)) END AS r2,
       count(*) FILTER (model_used = model) AS n_model
FROM (SELECT f.*, f.PredictedVehicles AS p, h.Vehicles AS a FROM ({body}) f JOIN hourly h ON h.RouteId = f.RouteId AND h.DateTime = f.DateTime)
GROUP BY 1, 2, 3
""", [*needs, "hourly"]


# The pooled regression: every origin's rows, centred by route, their correlations, and the
# elimination of one regressor after the other as a recursion over the cells of the matrix.

_X = ", ".join(f"x.{n}" for n in fc.REGRESSORS)
_SIZE = len(fc.REGRESSORS) + 1

table("regressors", """
SELECT t.RouteId, t.origin, t.DateTime, w.Vehicles AS seasonal_naive, d.Vehicles AS daily_naive, s.m AS history_mean,
       l.Vehicles AS last_value, s.n_history,
       sin(2 * pi() * hour(t.DateTime) / 24) AS hour_sin, cos(2 * pi() * hour(t.DateTime) / 24) AS hour_cos,
       sin(2 * pi() * (isodow(t.DateTime) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(t.DateTime) - 1) / 7) AS dow_cos
FROM targets t JOIN stats s USING (RouteId, origin)
JOIN hourly w ON w.RouteId = t.RouteId AND w.DateTime = t.DateTime - INTERVAL 168 HOUR
JOIN hourly d ON d.RouteId = t.RouteId AND d.DateTime = t.DateTime - INTERVAL 24 HOUR
JOIN hourly l ON l.RouteId = t.RouteId AND l.DateTime = t.origin - INTERVAL 1 HOUR
""", "targets", "stats", "hourly")
table("train_cells", f"""
SELECT o.origin, x.RouteId, x.DateTime, unnest(range({_SIZE})) AS i, unnest([{_X}, a.Vehicles]) AS v
FROM (SELECT DISTINCT origin FROM origins) o JOIN regressors x ON x.origin < o.origin
JOIN hourly a ON a.RouteId = x.RouteId AND a.DateTime = x.DateTime
WHERE x.n_history >= {RELAXED}
""", "origins", "regressors", "hourly")
table("train_centred", """
SELECT *, CASE WHEN max(v) OVER g = min(v) OVER g THEN 0 ELSE v - avg(v) OVER g END AS c, avg(v) OVER g AS mean
FROM train_cells WINDOW g AS (PARTITION BY origin, RouteId, i)
""", "train_cells")
table("train_spread", """
SELECT origin, i, sqrt(sum(c * c)) AS spread, count(*) AS n_rows, count(DISTINCT RouteId) AS n_routes
FROM train_centred GROUP BY 1, 2
""", "train_centred")
table("train_means", "SELECT DISTINCT origin, RouteId, i, mean FROM train_centred", "train_centred")
table("correlations", """
SELECT a.origin, a.i, b.i AS j, coalesce(sum(a.c * b.c) / nullif(any_value(p.spread) * any_value(q.spread), 0), 0) AS v
FROM train_centred a JOIN train_centred b USING (origin, RouteId, DateTime)
JOIN train_spread p ON p.origin = a.origin AND p.i = a.i JOIN train_spread q ON q.origin = b.origin AND q.i = b.i
GROUP BY 1, 2, 3
""", "train_centred", "train_spread")
table("eliminated", f"""
SELECT origin, i, j, v, 0 AS p FROM correlations
UNION ALL
SELECT origin, i, j, CASE WHEN i = p THEN CASE WHEN head > 1e-10 THEN v / head ELSE 0 END
                          WHEN head > 1e-10 THEN v - of_column * of_row / head ELSE v END, p + 1
FROM (SELECT *, max(CASE WHEN i = p AND j = p THEN v END) OVER (PARTITION BY origin) AS head,
             max(CASE WHEN j = p THEN v END) OVER (PARTITION BY origin, i) AS of_column,
             max(CASE WHEN i = p THEN v END) OVER (PARTITION BY origin, j) AS of_row
      FROM eliminated WHERE p < {_SIZE - 1})
""", "correlations")
table("slopes", f"""
SELECT e.origin, e.i, coalesce(e.v * y.spread / nullif(x.spread, 0), 0) AS slope
FROM eliminated e JOIN train_spread x ON x.origin = e.origin AND x.i = e.i
JOIN train_spread y ON y.origin = e.origin AND y.i = {_SIZE - 1}
WHERE e.p = {_SIZE - 1} AND e.j = {_SIZE - 1} AND e.i < {_SIZE - 1} AND x.n_rows > x.n_routes + {_SIZE - 1}
""", "eliminated", "train_spread")
table("p_linear", f"""
SELECT x.RouteId, x.origin, x.DateTime, any_value(y.mean) + sum(s.slope * (x.v - m.mean)) AS v
FROM (SELECT RouteId, origin, DateTime, unnest(range({_SIZE - 1})) AS i, unnest([{_X}]) AS v FROM regressors x) x
JOIN slopes s ON s.origin = x.origin AND s.i = x.i
JOIN train_means m ON m.origin = x.origin AND m.RouteId = x.RouteId AND m.i = x.i
JOIN train_means y ON y.origin = x.origin AND y.RouteId = x.RouteId AND y.i = {_SIZE - 1}
GROUP BY 1, 2, 3
""", "regressors", "slopes", "train_means")


def _linear_oracle(select, *needs):
    return sql(select, *needs, recursive=True)


_LINEAR, _LINEAR_NEEDS = _forecast_sql(["linear"], RELAXED)


@query("fc_07_linear", _linear_oracle(f"""
SELECT RouteId, origin, DateTime, step, model, {rd('PredictedVehicles', 'PredictedVehicles', 3)}, model_used, n_history
FROM ({_LINEAR})
""", *_LINEAR_NEEDS), places=3)
def fc_07_origins(spark, sf):
    """One regression per origin over all routes, from sums by day; no iteration."""
    return _run(spark, sf, ["linear"], min_history=RELAXED)


@query("fc_07_linear_certificate", sql("""
SELECT o.origin, coalesce(s.n_rows, 0) AS n_rows, coalesce(s.n_routes, 0) AS n_routes,
       CASE WHEN s.n_rows > s.n_routes + 8 THEN true END AS optimal
FROM (SELECT DISTINCT origin FROM origins) o LEFT JOIN train_spread s ON s.origin = o.origin AND s.i = 8
""", "origins", "train_spread"))
def fc_07_certificate(spark, sf):
    """What each fit saw, and whether no regressor is correlated with its residual."""
    hourly = t.hourly(spark, sf)
    fits, _ = fc.fit_linear(hourly, _origins(hourly), min_history=RELAXED)
    optimal = F.when(F.col("slopes").isNotNull(), pooled.gradient(len(fc.REGRESSORS) + 1) < 1e-4)
    return fits.select("origin", "n_rows", "n_routes", optimal.alias("optimal"))


@query("fc_07_linear_backtest", _linear_oracle(f"""
SELECT RouteId, date, model, n, {rd('mse', 'mse', 3)}, {rd('rmse', 'rmse', 3)}, {rd('mae', 'mae', 3)},
       {rd('smape', 'smape', 3)}, n_model FROM ({_scores_sql(["linear"], RELAXED)[0]})
""", *_scores_sql(["linear"], RELAXED)[1]), places=3)
def fc_07_backtest(spark, sf):
    rows = backtest.daily_metrics(t.obs(spark, sf), models=["linear"], min_history=RELAXED)
    return rows.select("RouteId", "date", "model", "n", "mse", "rmse", "mae", "smape", "n_model")


# Rollouts: SQL carries the week of hours from day to day as a list.

table("anchors", "SELECT RouteId, CAST(max(DateTime) AS DATE) AS anchor FROM obs GROUP BY 1", "obs")
table("week", """
SELECT a.RouteId, a.anchor, list(h.Vehicles ORDER BY k) AS vals, list(coalesce(h.n, 0) ORDER BY k) AS raws
FROM anchors a JOIN (SELECT unnest(range(168)) AS k) ON true
LEFT JOIN (SELECT RouteId, date_trunc('hour', DateTime) AS DateTime, avg(Vehicles) AS Vehicles, count(*) AS n FROM obs GROUP BY 1, 2) h
  ON h.RouteId = a.RouteId AND h.DateTime = CAST(a.anchor + 1 AS TIMESTAMP) - INTERVAL 168 HOUR + to_hours(CAST(k AS INTEGER))
GROUP BY 1, 2
""", "anchors", "obs")
table("profile_list", """
SELECT RouteId, list(v ORDER BY k) AS prof
FROM (SELECT a.RouteId, k, h.v FROM anchors a JOIN (SELECT unnest(range(168)) AS k) ON true
      LEFT JOIN (SELECT RouteId, (isodow(DateTime) - 1) * 24 + hour(DateTime) AS k, avg(Vehicles) AS v FROM hourly GROUP BY 1, 2) h
        USING (RouteId, k)) GROUP BY RouteId
""", "anchors", "hourly")


# The fits of rollouts take the whole series, whose end lies before the first forecast day.
table("roll_filled", """
SELECT f.RouteId, CAST(a.anchor + 1 AS TIMESTAMP) AS origin, f.DateTime, f.Vehicles AS v
FROM filled f JOIN anchors a USING (RouteId)
""", "filled", "anchors")
_fit("roll_ar1_fit", "roll_filled", 0)
_fit("roll_sar1_fit", "roll_filled", 24)
for _model in ("ar1", "sar1"):
    table(f"{_model}_list", f"""
SELECT a.RouteId, [f.phi, f.mu] AS prof FROM anchors a LEFT JOIN roll_{_model}_fit f USING (RouteId)
""", "anchors", f"roll_{_model}_fit")
_LAST = {
    "ar1": "list_max([CASE WHEN vals[i] IS NOT NULL THEN i END FOR i IN range(1, 169)])",
    "sar1": "list_max([CASE WHEN vals[i] IS NOT NULL AND vals[i - 24] IS NOT NULL THEN i END FOR i IN range(25, 169)])",
}


def _rollout_sql(model, n_days, min_history, name="roll"):
    answer = {
        "ar1": "(prof[2] + pow(prof[1], 169 + h - l) * (vals[l] - prof[2]))",
        "sar1": "(vals[144 + h + 1] + prof[2] + pow(prof[1], 169 + h - l) * (vals[l] - vals[l - 24] - prof[2]))",
        "seasonal_naive": "vals[h + 1]",
        "daily_naive": "vals[144 + h + 1]",
        "profile": "prof[((isodow(anchor) - 1 + k + 1) % 7) * 24 + h + 1]",
    }[model]
    return f"""
{name} AS (
  SELECT w.RouteId, w.anchor, p.prof, 0 AS k, w.vals, w.raws, CAST(NULL AS DOUBLE[]) AS new, CAST(NULL AS BOOLEAN[]) AS own
  FROM week w JOIN {model + "_list" if model in _LAST else "profile_list"} p USING (RouteId)
  UNION ALL
  SELECT RouteId, anchor, prof, k + 1, list_concat(vals[25:168], new), list_concat(raws[25:168], [1 FOR h IN range(24)]), new, own
  FROM (SELECT RouteId, anchor, prof, k, vals, raws,
          [greatest(coalesce(CASE WHEN n >= {min_history} THEN {answer} END, mean), 0) FOR h IN range(24)] AS new,
          [n >= {min_history} AND {answer} IS NOT NULL FOR h IN range(24)] AS own
        FROM (SELECT *, list_avg(vals) AS mean, list_count(vals) AS n, {_LAST.get(model, "0")} AS l FROM {name} WHERE k < {n_days}
              AND list_sum(raws) >= 168))
)"""


def _rollout_rows(model, name="roll"):
    return f"""
SELECT RouteId, anchor, CAST(anchor + CAST(k AS INTEGER) AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS DateTime,
       '{model}' AS model, new[h + 1] AS v, CASE WHEN own[h + 1] THEN '{model}' ELSE 'baseline' END AS model_used
FROM {name}, (SELECT unnest(range(24)) AS h) WHERE k > 0
"""


def _rollout_oracle(model, n_days, min_history):
    head = sql("", "week", f"{model}_list" if model in _LAST else "profile_list", recursive=True)
    return f"""{head},{_rollout_sql(model, n_days, min_history)}
SELECT RouteId, anchor, DateTime, model, {rd('v', 'PredictedVehicles')}, model_used FROM ({_rollout_rows(model)})"""


@query("fc_09_rollout_strict", _rollout_oracle("seasonal_naive", 7, 168))
def fc_09(spark, sf):
    return fc.rollout(t.obs(spark, sf))


@query("fc_09_rollout_seasonal", _rollout_oracle("seasonal_naive", 8, 100))
def fc_09_seasonal(spark, sf):
    return fc.rollout(t.obs(spark, sf), n_days=8, min_history=100)


@query("fc_09_rollout_daily", _rollout_oracle("daily_naive", 8, 100))
def fc_09_daily(spark, sf):
    return fc.rollout(t.obs(spark, sf), "daily_naive", n_days=8, min_history=100)


@query("fc_09_rollout_profile", _rollout_oracle("profile", 8, 100))
def fc_09_profile(spark, sf):
    return fc.rollout(t.obs(spark, sf), "profile", n_days=8, min_history=100)


@query("fc_09_rollout_ar1", _rollout_oracle("ar1", 8, 100))
def fc_09_ar1(spark, sf):
    return fc.rollout(t.obs(spark, sf), "ar1", n_days=8, min_history=100)


@query("fc_09_rollout_sar1", _rollout_oracle("sar1", 8, 100))
def fc_09_sar1(spark, sf):
    return fc.rollout(t.obs(spark, sf), "sar1", n_days=8, min_history=100)


_E = ["seasonal_naive", "daily_naive", "profile"]


def _ensemble_oracle():
    body, needs = _forecast_sql(_E, RELAXED)
    cols = ", ".join(rd(f"{m}_v", f"Pred_{m}") for m in _E)
    total = " + ".join(f"{m}_v" for m in _E)
    picks = ", ".join(f"max(PredictedVehicles) FILTER (model = '{m}') AS {m}_v" for m in _E)
    return sql(f"""
SELECT RouteId, DateTime, {cols}, {rd(f'({total}) / 3', 'Pred_ENSEMBLE')},
       {rd('(seasonal_naive_v + profile_v) / 2', 'Pred_PAIR_AVG')}, {rd(f'({total}) / 3', 'PredictedVehicles')}
FROM (SELECT RouteId, DateTime, {picks} FROM ({body}) GROUP BY 1, 2)
""", *needs)


@query("fc_11_ensemble", _ensemble_oracle())
def fc_11(spark, sf):
    rows = _run(spark, sf, _E, min_history=RELAXED)
    return fc.ensemble(rows, _E, ("seasonal_naive", "profile"))


@query("fc_11_single_model", sql(f"""
SELECT RouteId, DateTime, {rd('PredictedVehicles', 'Pred_seasonal_naive')}, {rd('PredictedVehicles', 'Pred_ENSEMBLE')},
       {rd('PredictedVehicles', 'PredictedVehicles')} FROM ({_forecast_sql(['seasonal_naive'], RELAXED)[0]})
""", *_forecast_sql(["seasonal_naive"], RELAXED)[1]))
def fc_11_single(spark, sf):
    return fc.ensemble(_run(spark, sf, ["seasonal_naive"], min_history=RELAXED), ["seasonal_naive"])


def _week_oracle():
    head = sql("", "week", "profile_list", recursive=True)
    a, b = "roll_s", "roll_d"
    moved = """TIMESTAMP '2024-02-01' + to_days(CAST((isodow(s.DateTime) - 4 + 7) % 7 AS INTEGER))
       + (s.DateTime - date_trunc('day', s.DateTime))"""
    return f"""{head},{_rollout_sql('seasonal_naive', 8, 100, a)},{_rollout_sql('daily_naive', 8, 100, b)}
SELECT RouteId, DateTime, {rd('avg(x)', 'Pred_seasonal_naive')}, {rd('avg(y)', 'Pred_daily_naive')},
       {rd('avg((x + y) / 2)', 'Pred_ENSEMBLE')}, {rd('avg((x + y) / 2)', 'PredictedVehicles')}
FROM (SELECT s.RouteId, {moved} AS DateTime, s.v AS x, d.v AS y
      FROM ({_rollout_rows('seasonal_naive', a)}) s JOIN ({_rollout_rows('daily_naive', b)}) d USING (RouteId, DateTime))
WHERE DateTime >= TIMESTAMP '2024-02-01 09:00:00' GROUP BY 1, 2"""


@query("fc_11_week_ahead", _week_oracle())
def fc_11_week(spark, sf):
    return fc.week_ahead(t.obs(spark, sf), "2024-02-01", "2024-02-01 09:41:00", min_history=100)


def _daily_oracle(min_history):
    body, needs = _forecast_sql(COMPARED, min_history, "days_all")
    picks = ", ".join(
        f"sum(PredictedVehicles) FILTER (model = '{m}') AS {m}_v" for m in COMPARED
    )
    cols = ", ".join(rd(f"{m}_v", f"Daily_{m}") for m in COMPARED)
    return sql(f"""
SELECT d.RouteId, d.Date, {rd('d.DailyActual', 'DailyActual')}, {cols}
FROM daily d JOIN (SELECT RouteId, max(Date) - 30 AS start FROM daily GROUP BY 1) m ON m.RouteId = d.RouteId AND d.Date >= m.start
LEFT JOIN (SELECT RouteId, CAST(origin AS DATE) AS Date, {picks} FROM ({body}) WHERE n_history > 0 GROUP BY 1, 2) p
  ON p.RouteId = d.RouteId AND p.Date = d.Date
""", "daily", *needs)


@query("fc_12_daily_actual_vs_models", _daily_oracle(RELAXED))
def fc_12(spark, sf):
    return fc.daily_actual_vs_models(t.obs(spark, sf), COMPARED, min_history=RELAXED)


@query("fc_12_daily_actual_vs_models_strict", _daily_oracle(168))
def fc_12_strict(spark, sf):
    return fc.daily_actual_vs_models(t.obs(spark, sf), COMPARED)


_SIX_COLUMNS = ", ".join(rd(m, m) for m in ("mse", "rmse", "mae", "mape", "smape", "r2"))


def _daily_scores_oracle(min_history):
    body, needs = _scores_sql(COMPARED, min_history)
    return sql(f"SELECT RouteId, date, model, n, {_SIX_COLUMNS}, n_model FROM ({body})", *needs)


@query("fc_13_backtest_daily_metrics", _daily_scores_oracle(RELAXED))
def fc_13(spark, sf):
    return backtest.daily_metrics(t.obs(spark, sf), models=COMPARED, min_history=RELAXED)


@query("fc_13_backtest_daily_metrics_strict", _daily_scores_oracle(168))
def fc_13_strict(spark, sf):
    return backtest.daily_metrics(t.obs(spark, sf), models=COMPARED)


def _averages_sql(min_history):
    body, needs = _scores_sql(COMPARED, min_history)
    return f"""
SELECT RouteId, model, avg(mse) AS mse, avg(rmse) AS rmse, avg(mae) AS mae, avg(mape) AS mape,
       avg(smape) AS smape, avg(r2) AS r2, count(*) AS n_days FROM ({body}) GROUP BY 1, 2""", needs


def _top_oracle(min_history):
    body, needs = _averages_sql(min_history)
    return sql(f"""
SELECT RouteId, model, {_SIX_COLUMNS}, n_days, {rd('coalesce(smape, rmse)', 'score')}, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY round(coalesce(smape, rmse), 9), model) AS rank FROM ({body}))
WHERE rank <= 2
""", *needs)


@query("fc_13_backtest_top_models", _top_oracle(RELAXED))
def fc_13_top(spark, sf):
    return backtest.run(t.obs(spark, sf), models=COMPARED, min_history=RELAXED)[2]


table("last_rows", """
SELECT RouteId, Vehicles, 192 - (n - p) AS s FROM numbered WHERE n >= 192 AND n - p <= 192
""", "numbered")


def _summary_oracle():
    body, needs = _averages_sql(RELAXED)
    return sql(f"""
SELECT 'Metro' AS city, '(All)' AS zone, a.RouteId AS route_id, 'Metro' AS family_name,
       strftime(any_value(s.first) + 1, '%Y-%m-%d') AS eval_start_date, strftime(any_value(s.last) - 1, '%Y-%m-%d') AS eval_end_date,
       CAST(any_value(s.last) - any_value(s.first) - 1 AS INTEGER) AS n_days_evaluated,
       list_aggregate(list(model ORDER BY round(coalesce(smape, rmse), 9), model)[1:2], 'string_agg', ',') AS top_models,
       string_agg(model, ',' ORDER BY model) AS models
FROM ({body}) a JOIN spans s ON s.RouteId = a.RouteId GROUP BY a.RouteId
""", *needs, "spans")


@query("fc_13_backtest_summary", _summary_oracle())
def fc_13_summary(spark, sf):
    obs = t.obs(spark, sf)
    daily = backtest.daily_metrics(obs, models=COMPARED, min_history=RELAXED)
    rows = backtest.summary(obs, daily, "Metro", "(All)", "Metro")
    return rows.withColumns({
        "top_models": F.array_join("top_models", ","),
        "models": F.array_join(F.array_sort(F.map_keys("metrics_avg")), ","),
    }).drop("metrics_avg")


@query("fc_15_holdout_metrics", sql(f"""
SELECT RouteId, {rd('sqrt(avg((Vehicles - p) ** 2))', 'RMSE')}, {rd('avg(abs(Vehicles - p))', 'MAE')}
FROM (SELECT t.RouteId, t.Vehicles, b.Vehicles + f.c / (1 - f.phi) + pow(f.phi, t.s - 167) * (f.last - f.c / (1 - f.phi)) AS p
      FROM last_rows t
      JOIN last_rows b ON b.RouteId = t.RouteId AND b.s = t.s - 24
      JOIN (SELECT RouteId, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, arg_max(y, s) AS last
            FROM (SELECT *, lag(y) OVER (PARTITION BY RouteId ORDER BY s) AS x
                  FROM (SELECT RouteId, s, Vehicles - lag(Vehicles, 24) OVER (PARTITION BY RouteId ORDER BY s) AS y
                        FROM last_rows WHERE s < 168))
            GROUP BY 1) f ON f.RouteId = t.RouteId
      WHERE t.s >= 168 AND abs(f.phi) < 1)
GROUP BY RouteId
""", "last_rows"))
def fc_15(spark, sf):
    return backtest.holdout_metrics(t.hourly(spark, sf))
