"""Prediction-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import feedback as L
from barloom.operators.joins import asof_forward
from barloom.plans import retune as P

from . import tables as T
from .registry import query, shown
from .sql import cte

cte(
    "preds_all",
    """
SELECT p.dt AS date, p.dt + INTERVAL (h.hour) HOUR AS timestamp, p.symbol AS ticker, round(close, 2) AS spot_price, round(close * (1 - sd * h.width), 2) AS floor,
       round(close * (1 + sd * h.width), 2) AS ceiling, CASE WHEN close > open THEN 'BULLISH' WHEN close < open THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias,
       v.vix, v.regime
FROM (SELECT *, stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM rv_log) p
JOIN vix_r v ON v.symbol = p.symbol AND v.dt = p.dt
CROSS JOIN (VALUES (10, 2::DOUBLE), (16, 1::DOUBLE)) h(hour, width) WHERE p.i >= 25
""",
)
cte("preds", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY timestamp DESC) AS k FROM preds_all) WHERE k = 1")
cte(
    "scored",
    """
SELECT *, actual BETWEEN floor AND ceiling AS ok,
  (bias = 'BULLISH' AND actual > spot_price) OR (bias = 'BEARISH' AND actual < spot_price) OR bias = 'NEUTRAL' AS right_way,
  CASE WHEN actual < floor THEN (floor - actual) / spot_price * 100 WHEN actual > ceiling THEN (actual - ceiling) / spot_price * 100 ELSE 0 END AS err
FROM (SELECT p.*, x.close AS actual FROM preds p ASOF JOIN bars x ON x.symbol = p.ticker AND x.dt > p.date)
""",
)
cte("last_day", "SELECT max(date) AS d FROM preds")
cte("recent", "SELECT * FROM scored WHERE date >= (SELECT d - 90 FROM last_day)")


def preds(spark, sf):
    return L.latest_predictions(T.predictions(spark, sf))


def scored(spark, sf):
    return L.score_predictions(preds(spark, sf), T.bars(spark, sf))


def last_day(spark, sf):
    return preds(spark, sf).agg(F.max("date").alias("d")).scalar()


def recent_scored(spark, sf):
    return L.score_predictions(L.in_window(preds(spark, sf), last_day(spark, sf)), T.bars(spark, sf))


@query("pred_latest", "SELECT date, ticker, timestamp, spot_price, floor, ceiling, bias, vix, regime FROM preds")
def pred_latest(spark, sf):
    cols = ["date", "ticker", "timestamp", "spot_price", "floor", "ceiling", "bias", "vix", "regime"]
    return preds(spark, sf).select(*cols)


@query(
    "pred_scored",
    """
SELECT date, ticker, actual AS actual_close, ok AS in_range, right_way AS bias_correct, round(err, 6) AS range_error FROM scored
""",
)
def pred_scored(spark, sf):
    return shown(scored(spark, sf), "date", "ticker", "actual_close", "in_range", "bias_correct", "range_error")


@query(
    "asof_next_week",
    "SELECT b.symbol, b.dt, b.close, w.close AS next_week_close FROM bars b ASOF LEFT JOIN weeks w ON w.symbol = b.symbol AND w.wk > b.dt",
)
def asof_next_week(spark, sf):
    from barloom.operators.bars import weekly_bars

    panel = T.bars(spark, sf)
    weeks = weekly_bars(panel).withColumnRenamed("close", "next_week_close")
    return asof_forward(panel, weeks, ["next_week_close"]).select("symbol", "dt", "close", "next_week_close")


@query(
    "range_accuracy",
    """
SELECT count(*) AS predictions, round(avg(CASE WHEN ok THEN 100.0 ELSE 0 END), 6) AS range_accuracy, round(avg(CASE WHEN right_way THEN 100.0 ELSE 0 END), 6) AS bias_accuracy,
       round(avg(err), 6) AS mean_error
FROM scored
""",
)
def range_accuracy(spark, sf):
    return shown(L.range_accuracy(scored(spark, sf)))


@query(
    "recent_accuracy",
    """
SELECT ticker, count(*) AS predictions, round(avg(CASE WHEN ok THEN 100.0 ELSE 0 END), 6) AS range_accuracy, round(avg(CASE WHEN right_way THEN 100.0 ELSE 0 END), 6) AS bias_accuracy,
       round(avg(err), 6) AS mean_error
FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS j FROM scored) WHERE j <= 30 GROUP BY 1
""",
)
def recent_accuracy(spark, sf):
    return shown(L.recent_accuracy(scored(spark, sf)))


cte(
    "base_w",
    """
SELECT * FROM (VALUES (0, 'options_walls', 0.25::DOUBLE), (1, 'gex_levels', 0.20::DOUBLE), (2, 'iv_range', 0.20::DOUBLE), (3, 'fractals', 0.15::DOUBLE), (4, 'put_call_ratio', 0.10::DOUBLE),
  (5, 'iv_skew', 0.05::DOUBLE), (6, 'max_pain', 0.05::DOUBLE)) t(o, name, w)
""",
)
cte(
    "cur_w",
    """
SELECT b.name, coalesce(c.v, b.w) AS w FROM base_w b LEFT JOIN
(SELECT (['options_walls', 'gex_levels', 'iv_range', 'fractals', 'put_call_ratio', 'iv_skew', 'max_pain', 'retired_signal'])[event_id % 8 + 1] AS name,
        arg_max(round(value / 100, 4), event_id) AS v FROM events WHERE event_type <> 'error' GROUP BY 1) c ON c.name = b.name
""",
)


@query("current_weights", "SELECT name, round(w, 4) AS weight FROM cur_w")
def current_weights(spark, sf):
    return shown(L.current_weights(spark, T.weight_changes(spark, sf)), digits=4)


@query(
    "eligibility",
    """
SELECT count(DISTINCT date) AS days, count(*) FILTER (date >= (SELECT d - 90 FROM last_day)) AS recent_rows,
       count(DISTINCT date) >= 60 AND count(*) FILTER (date >= (SELECT d - 90 FROM last_day)) >= 20 AS eligible
FROM preds
""",
)
def eligibility(spark, sf):
    return L.eligibility(preds(spark, sf), last_day(spark, sf))


def scale_sql(w: str) -> str:
    return f"({w}.iv / 0.20 * 0.4 + {w}.fr / 0.15 * 0.3 + {w}.wa / 0.25 * 0.3)"


def inside_sql(scale: str) -> str:
    return (
        f"CASE WHEN spot_price <> 0 AND actual BETWEEN (floor + ceiling) / 2 - (ceiling - floor) * {scale} / 2 "
        f"AND (floor + ceiling) / 2 + (ceiling - floor) * {scale} / 2 THEN 100.0 ELSE 0 END"
    )


def loo_sql(weights: str) -> str:
    return f"""
SELECT s.name, round(b.acc - s.acc, 2) AS score FROM
(SELECT m.name, avg({inside_sql(scale_sql('m'))}) AS acc FROM recent CROSS JOIN
  (SELECT d.name, max(CASE WHEN k.name = 'iv_range' THEN v END) AS iv, max(CASE WHEN k.name = 'fractals' THEN v END) AS fr, max(CASE WHEN k.name = 'options_walls' THEN v END) AS wa
   FROM (SELECT d.name AS dn, k.name, CASE WHEN d.name = k.name THEN 0 ELSE k.w * (1 + d.w / (t.total - d.w)) END AS v
         FROM {weights} d CROSS JOIN {weights} k CROSS JOIN (SELECT sum(w) AS total FROM {weights}) t) k JOIN {weights} d ON d.name = k.dn GROUP BY 1) m GROUP BY 1) s
CROSS JOIN (SELECT avg(CASE WHEN ok THEN 100.0 ELSE 0 END) AS acc FROM recent) b
"""


cte("loo", loo_sql("base_w"))
cte("loo_cur", loo_sql("cur_w"))


@query("leave_one_out", "SELECT name, score FROM loo")
def leave_one_out(spark, sf):
    recent = recent_scored(spark, sf)
    return L.leave_one_out(recent, L.weight_table(spark))


@query("leave_one_out_current", "SELECT name, score FROM loo_cur")
def leave_one_out_current(spark, sf):
    recent = recent_scored(spark, sf)
    return L.leave_one_out(recent, L.current_weights(spark, T.weight_changes(spark, sf)))


cte(
    "prop",
    """
SELECT name, w, CASE WHEN flat THEN w ELSE c / sum(c) OVER () END AS p
FROM (SELECT name, w, min(score) OVER () = max(score) OVER () AS flat, greatest(0.02, least(0.40, w * (1 + score / greatest(max(abs(score)) OVER (), 0.01) * 0.15)))::DOUBLE AS c
      FROM base_w JOIN loo USING (name))
""",
)


@query("proposed_weights", "SELECT name, w AS old_weight, round(p, 6) AS weight FROM prop")
def proposed_weights(spark, sf):
    recent = recent_scored(spark, sf)
    w = L.weight_table(spark)
    return shown(L.proposed_weights(w, L.leave_one_out(recent, w)))


cte(
    "recent_n",
    "SELECT *, row_number() OVER (ORDER BY timestamp, substr(md5(ticker), 1, 3), ticker) AS j, count(*) OVER () AS total FROM recent",
)
cte("held", "SELECT * FROM recent_n WHERE j > floor(round(total * 0.8, 6))")


@query("holdout_rows", "SELECT date, ticker FROM held")
def holdout_rows(spark, sf):
    recent = recent_scored(spark, sf)
    return L.holdout_rows(recent).select("date", "ticker")


cte(
    "hold",
    f"""
SELECT count(*) AS k, round(avg({inside_sql('1.0::DOUBLE')}), 1) AS ba, round(avg({inside_sql(scale_sql('m'))}), 1) AS pa
FROM held CROSS JOIN (SELECT max(CASE WHEN name = 'iv_range' THEN p END) AS iv, max(CASE WHEN name = 'fractals' THEN p END) AS fr, max(CASE WHEN name = 'options_walls' THEN p END) AS wa FROM prop) m
""",
)


@query(
    "holdout_check",
    "SELECT k AS held_out, ba AS baseline_accuracy, pa AS proposed_accuracy, pa >= ba AND pa >= 65 AS passed FROM hold",
)
def holdout_check(spark, sf):
    recent = recent_scored(spark, sf)
    w = L.weight_table(spark)
    return L.holdout_check(recent, L.proposed_weights(w, L.leave_one_out(recent, w)), w)


@query(
    "regime_adjust",
    """
SELECT regime, count(*) AS predictions, round(avg(CASE WHEN ok THEN 100.0 ELSE 0 END), 1) AS accuracy, round(avg(ceiling - floor) / avg(spot_price) * 100, 2) AS width_pct,
       (CASE WHEN avg(CASE WHEN ok THEN 100.0 ELSE 0 END) > 75 THEN 0.85 WHEN avg(CASE WHEN ok THEN 100.0 ELSE 0 END) > 65 THEN 1.0
             WHEN avg(CASE WHEN ok THEN 100.0 ELSE 0 END) > 55 THEN 1.15 ELSE 1.3 END)::DOUBLE AS range_scale
FROM scored GROUP BY 1 HAVING count(*) >= 5
""",
)
def regime_adjust(spark, sf):
    return L.regime_adjustments(scored(spark, sf))


@query(
    "retune_report",
    """
SELECT e.*, k AS held_out, ba AS baseline_accuracy, pa AS proposed_accuracy, pa >= ba AND pa >= 65 AS passed FROM hold CROSS JOIN
(SELECT count(DISTINCT date) AS days, count(*) FILTER (date >= (SELECT d - 90 FROM last_day)) AS recent_rows,
        count(DISTINCT date) >= 60 AND count(*) FILTER (date >= (SELECT d - 90 FROM last_day)) >= 20 AS eligible FROM preds) e
""",
)
def retune_report(spark, sf):
    r = P.retune(spark, preds(spark, sf), T.bars(spark, sf), last_day(spark, sf), L.weight_table(spark))
    return r.report


@query(
    "retune_changes",
    """
SELECT name AS weight_name, w AS old_value, round(p, 6) AS new_value FROM prop CROSS JOIN hold WHERE pa >= ba AND pa >= 50 AND abs(p - w) > 0.001
""",
)
def retune_changes(spark, sf):
    w = L.weight_table(spark)
    r = P.retune(spark, preds(spark, sf), T.bars(spark, sf), last_day(spark, sf), w, min_accuracy=0.5)
    return shown(r.changes)
