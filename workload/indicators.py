"""Bars and indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.chunked import add_ewm_chunked, add_peak_chunked, add_position_chunked
from barloom.functions.ewm import Ewm, add_ewm_gaps, span
from barloom.functions.windows import row_index, series
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import structure as S
from barloom.operators.joins import asof_backward, asof_calendar

from . import tables as T
from .registry import query, rl, shown
from .sql import cte

W = "OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"

# ---- bars ---------------------------------------------------------------------


@query("bars_daily", "SELECT * FROM bars")
def bars_daily(spark, sf):
    return T.bars(spark, sf)


cte(
    "weeks",
    """
SELECT symbol, CAST(date_trunc('week', dt) AS DATE) + 6 AS wk, arg_min(open, dt) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume
FROM bars GROUP BY 1, 2
""",
)


@query("bars_weekly", "SELECT symbol, wk AS dt, open, high, low, close, volume FROM weeks")
def bars_weekly(spark, sf):
    return B.weekly_bars(T.bars(spark, sf))


@query(
    "bars_from_trades",
    """
SELECT event_type AS symbol, date_trunc('hour', ts) AS dt, arg_min(value, ts) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, ts) AS close, CAST(sum(user_id % 100 + 1) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2
""",
)
def bars_from_trades(spark, sf):
    hour = F.date_trunc("hour", "ts")
    return B.trades_to_bars(T.ticks(spark, sf), hour, order=("ts", "event_id"))


@query("vix_daily", "SELECT * FROM vix")
def vix_daily(spark, sf):
    return T.vix(spark, sf)


@query("chain_table", "SELECT * FROM chain")
def chain_table(spark, sf):
    return T.chain(spark, sf)


cte(
    "month_last",
    "SELECT symbol, last_day(dt) AS m, arg_max(close, dt) AS c FROM bars GROUP BY 1, 2",
)
cte(
    "month_ret",
    """
SELECT * FROM (SELECT symbol, m, (c / lag(c) OVER (PARTITION BY symbol ORDER BY m) - 1) * 100 AS r FROM month_last)
WHERE r IS NOT NULL
""",
)


@query("monthly_returns", "SELECT symbol, m AS month_end, round(r, 6) AS return_pct FROM month_ret")
def monthly_returns(spark, sf):
    return shown(B.monthly_returns(T.bars(spark, sf), "close"))


@query(
    "monthly_pivot",
    f"""
SELECT symbol, CAST(year(m) AS INTEGER) AS year,
{", ".join(f"round(sum(CASE WHEN month(m) = {k} THEN r END), 6) AS m{k:02d}" for k in range(1, 13))}
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM month_ret) WHERE k >= 3 GROUP BY 1, 2
""",
)
def monthly_pivot(spark, sf):
    return shown(B.monthly_pivot(T.bars(spark, sf), "close"))


@query(
    "period_ytd",
    """
SELECT symbol, greatest(min(dt), CAST(date_trunc('year', max(dt)) AS DATE)) AS start_dt, max(dt) AS end_dt
FROM bars GROUP BY 1
""",
)
def period_ytd(spark, sf):
    return B.period_bounds(T.bars(spark, sf), "YTD")


@query(
    "period_6m_bars",
    """
SELECT bars.* FROM bars JOIN (SELECT symbol, max(dt) AS last FROM bars GROUP BY 1) USING (symbol)
WHERE dt >= CAST(last - INTERVAL 6 MONTH AS DATE)
""",
)
def period_6m_bars(spark, sf):
    return B.in_period(T.bars(spark, sf), "6M")


@query("last_rows", "SELECT symbol, dt, close FROM b WHERE i >= n - 5")
def last_rows(spark, sf):
    return B.last_rows(T.bars(spark, sf), 5).select("symbol", "dt", "close")


@query("with_history", "SELECT symbol, dt, close FROM b WHERE n >= 530")
def with_history(spark, sf):
    return B.with_history(T.bars(spark, sf), 530).select("symbol", "dt", "close")


# ---- windows -------------------------------------------------------------------


@query(
    "sma",
    f"SELECT symbol, dt, round({rl('avg', 'close', 50)}, 6) AS sma_50, round({rl('avg', 'close', 200)}, 6) AS sma_200 FROM bars",
)
def sma(spark, sf):
    return shown(I.add_sma(T.bars(spark, sf)), "symbol", "dt", "sma_50", "sma_200")


cte(
    "bb",
    f"""
SELECT *, mid + 2 * sd AS upper, mid - 2 * sd AS lower, 4 * sd / mid AS bw
FROM (SELECT *, {rl('avg', 'close', 20)} AS mid, {rl('stddev_samp', 'close', 20)} AS sd FROM b)
""",
)


@query(
    "bollinger",
    "SELECT symbol, dt, round(mid, 4) AS bb_mid, round(upper, 4) AS bb_upper, round(lower, 4) AS bb_lower FROM bb",
)
def bollinger(spark, sf):
    return shown(I.add_bollinger(T.bars(spark, sf)), "symbol", "dt", "bb_mid", "bb_upper", "bb_lower", digits=4)


@query(
    "bandwidth",
    f"""
SELECT symbol, dt, round(bw, 6) AS bandwidth, round(coalesce({rl('min', 'bw', 20)}, bw), 6) AS bandwidth_min FROM bb
""",
)
def bandwidth(spark, sf):
    return shown(I.add_bandwidth_floor(T.bars(spark, sf)), "symbol", "dt", "bandwidth", "bandwidth_min")


@query(
    "lags",
    "SELECT symbol, dt, pc AS prev_close, close - pc AS change, round(close / pc - 1, 6) AS ret, round(ln(close / pc), 6) AS log_ret FROM b",
)
def lags(spark, sf):
    return shown(I.add_lags(T.bars(spark, sf)), "symbol", "dt", "prev_close", "change", "ret", "log_ret")


cte("tr", "SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM b")
cte("atr14", f"SELECT *, {rl('avg', 'tr', 14)} AS atr FROM tr")


@query("atr", "SELECT symbol, dt, tr AS true_range, round(atr, 6) AS atr, round(close - 2 * atr, 6) AS atr_stop FROM atr14")
def atr(spark, sf):
    return shown(I.add_atr_stop(I.add_atr(T.bars(spark, sf))), "symbol", "dt", "true_range", "atr", "atr_stop")


cte("tp", "SELECT *, (high + low + close) * volume AS tv FROM b")


@query("vwap", f"SELECT symbol, dt, round({rl('sum', 'tv', 20)} / (3 * {rl('sum', 'volume', 20)}), 6) AS vwap FROM tp")
def vwap(spark, sf):
    return shown(I.add_vwap(T.bars(spark, sf)), "symbol", "dt", "vwap")


cte("zs", f"SELECT *, (close - {rl('avg', 'close', 50)}) / {rl('stddev_samp', 'close', 50)} AS z FROM b")


@query("zscore", "SELECT symbol, dt, round(z, 6) AS zscore FROM zs")
def zscore(spark, sf):
    return shown(I.add_zscore(T.bars(spark, sf)), "symbol", "dt", "zscore")


cte(
    "donchian",
    """
SELECT *, CASE WHEN i >= 55 THEN max(high) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) END AS dh,
       CASE WHEN i >= 20 THEN min(low) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS dl
FROM b
""",
)


@query("donchian", "SELECT symbol, dt, dh AS donchian_high, dl AS donchian_low FROM donchian")
def donchian(spark, sf):
    return I.add_donchian(T.bars(spark, sf)).select("symbol", "dt", "donchian_high", "donchian_low")


cte(
    "rv_log",
    f"SELECT *, {rl('stddev_samp', 'lr', 20)} * sqrt(252) AS rv FROM (SELECT *, ln(close / pc) AS lr FROM b)",
)
cte(
    "rv_pct",
    f"SELECT *, {rl('stddev_samp', 'r', 20)} * sqrt(252) AS rv FROM (SELECT *, close / pc - 1 AS r FROM b)",
)


@query(
    "realized_vol",
    """
SELECT symbol, dt, round(rv, 6) AS realized_vol,
       round(CASE WHEN rv > 0 THEN least(3.0::DOUBLE, 0.15::DOUBLE / rv) END, 6) AS vol_scale FROM rv_pct
""",
)
def realized_vol(spark, sf):
    return shown(I.add_realized_vol(T.bars(spark, sf), log=False), "symbol", "dt", "realized_vol", "vol_scale")


@query(
    "parkinson",
    f"""
SELECT symbol, dt, round(sqrt({rl('avg', 'hl', 20)} / (4 * ln(2)) * 252), 6) AS parkinson_vol
FROM (SELECT *, ln(high / low) * ln(high / low) AS hl FROM b)
""",
)
def parkinson(spark, sf):
    return shown(I.add_parkinson(T.bars(spark, sf)), "symbol", "dt", "parkinson_vol")


@query(
    "volume_ratio",
    f"""
SELECT symbol, dt, round(q, 6) AS volume_ratio, coalesce(q > 1.5, false) AS volume_surge
FROM (SELECT *, volume / {rl('avg', 'volume', 20)} AS q FROM b)
""",
)
def volume_ratio(spark, sf):
    return shown(I.add_volume_ratio(T.bars(spark, sf)), "symbol", "dt", "volume_ratio", "volume_surge")


cte(
    "atr_q",
    f"""
SELECT *, CASE WHEN am > 0 THEN atr / am ELSE 1 END AS aq
FROM (SELECT *, coalesce({rl('avg', 'atr', 60)}, atr) AS am FROM atr14)
""",
)


@query("atr_ratio", "SELECT symbol, dt, round(aq, 6) AS atr_ratio FROM atr_q")
def atr_ratio(spark, sf):
    return shown(I.add_atr_ratio(T.bars(spark, sf)), "symbol", "dt", "atr_ratio")


@query(
    "drawdown",
    f"""
SELECT symbol, dt, pk AS peak, round((close - pk) / pk, 6) AS drawdown
FROM (SELECT *, max(close) {W} AS pk FROM bars)
""",
)
def drawdown(spark, sf):
    return shown(I.add_drawdown(T.bars(spark, sf), "close"), "symbol", "dt", "peak", "drawdown")


@query(
    "rolling_sharpe",
    f"""
SELECT symbol, dt, round({rl('avg', 'r', 63)} / {rl('stddev_samp', 'r', 63)} * sqrt(252), 6) AS rolling_sharpe FROM rv_pct
""",
)
def rolling_sharpe(spark, sf):
    return shown(I.add_rolling_sharpe(T.bars(spark, sf), "close"), "symbol", "dt", "rolling_sharpe")


# ---- exponential means: plain recursion in SQL ----------------------------------

cte(
    "ew",
    """
SELECT symbol, i, dt, close AS e12, close AS e26, close AS e20, tr AS t20, NULL::DOUBLE AS g, NULL::DOUBLE AS l,
       0::DOUBLE AS sig
FROM tr WHERE i = 0
UNION ALL
SELECT t.symbol, t.i, t.dt,
       e.e12 + (t.close - e.e12) * (2::DOUBLE / 13), e.e26 + (t.close - e.e26) * (2::DOUBLE / 27),
       e.e20 + (t.close - e.e20) * (2::DOUBLE / 21), e.t20 + (t.tr - e.t20) * (2::DOUBLE / 21),
       CASE WHEN e.g IS NULL THEN greatest(t.close - t.pc, 0)
            ELSE e.g + (greatest(t.close - t.pc, 0) - e.g) * (1::DOUBLE / 14) END,
       CASE WHEN e.l IS NULL THEN greatest(t.pc - t.close, 0)
            ELSE e.l + (greatest(t.pc - t.close, 0) - e.l) * (1::DOUBLE / 14) END,
       e.sig + ((e.e12 + (t.close - e.e12) * (2::DOUBLE / 13)) - (e.e26 + (t.close - e.e26) * (2::DOUBLE / 27)) - e.sig)
           * (2::DOUBLE / 10)
FROM ew e JOIN tr t ON t.symbol = e.symbol AND t.i = e.i + 1
""",
)
cte(
    "ewx",
    """
SELECT symbol, i, dt, e12, e26, e20, t20, e12 - e26 AS macd, sig,
       CASE WHEN i >= 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi
FROM ew
""",
)


@query("ema", "SELECT symbol, dt, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26 FROM ewx")
def ema(spark, sf):
    return shown(I.add_ema(T.bars(spark, sf)), "symbol", "dt", "ema_12", "ema_26")


cte("gaps", "SELECT symbol, i, dt, CASE WHEN CAST(volume AS BIGINT) % 3 > 0 AND i % 97 < 90 THEN close END AS x FROM b")
cte(
    "ewg",
    """
SELECT symbol, i, dt, x AS y, x AS z, CASE WHEN x IS NOT NULL THEN 1::DOUBLE END AS wy, CASE WHEN x IS NOT NULL THEN 1::DOUBLE END AS wz
FROM gaps WHERE i = 0
UNION ALL
SELECT g.symbol, g.i, g.dt,
       CASE WHEN g.x IS NULL THEN e.y WHEN e.y IS NULL THEN g.x ELSE (e.wy * 11 / 13 * e.y + 2::DOUBLE / 13 * g.x) / (e.wy * 11 / 13 + 2::DOUBLE / 13) END,
       CASE WHEN g.x IS NULL THEN e.z WHEN e.z IS NULL THEN g.x ELSE (e.wz * 25 / 27 * e.z + 2::DOUBLE / 27 * g.x) / (e.wz * 25 / 27 + 2::DOUBLE / 27) END,
       CASE WHEN g.x IS NOT NULL THEN 1 ELSE e.wy * 11 / 13 END, CASE WHEN g.x IS NOT NULL THEN 1 ELSE e.wz * 25 / 27 END
FROM ewg e JOIN gaps g ON g.symbol = e.symbol AND g.i = e.i + 1
""",
)


@query("ema_gaps", "SELECT symbol, dt, round(y, 4) AS ema_12, round(z, 4) AS ema_26 FROM ewg")
def ema_gaps(spark, sf):
    """Means of closes of which a third is missing, with whole weeks in between."""
    bars = T.bars(spark, sf).withColumn("_k", row_index(series()))
    x = F.when((F.col("volume").cast("bigint") % 3 > 0) & (F.col("_k") % 97 < 90), F.col("close"))
    means = [Ewm("ema_12", "x", span(12)), Ewm("ema_26", "x", span(26))]
    return shown(add_ewm_gaps(bars.withColumn("x", x), means), "symbol", "dt", "ema_12", "ema_26", digits=4)


cte(
    "minutes",
    """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i,
       CASE WHEN cents % 17 = 0 THEN 1 WHEN cents % 13 = 0 THEN -1 ELSE 0 END AS signal
FROM (SELECT event_type AS symbol, date_trunc('minute', ts) AS dt, CAST(round(max(value) * 100) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
""",
)


def minutes(spark, sf):
    """Highest price of each minute, in whole cents, and a signal: series that no task should hold whole."""
    bars = T.ticks(spark, sf).groupBy("symbol", F.date_trunc("minute", "ts").alias("dt")).agg(F.round(F.max("price") * 100).cast("bigint").alias("cents"))
    signal = F.when(F.col("cents") % 17 == 0, 1).when(F.col("cents") % 13 == 0, -1).otherwise(0)
    return bars.withColumn("signal", signal)


# Of 300 rows back (11/13)^300 is left, nothing in double precision.
@query(
    "ema_minutes",
    """
SELECT a.symbol, a.dt, round(sum(b.cents * pow(11::DOUBLE / 13, a.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE 2::DOUBLE / 13 END), 3) AS ema_12
FROM minutes a JOIN minutes b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 300 AND a.i GROUP BY 1, 2
""",
)
def ema_minutes(spark, sf):
    """Exponential means of minutes, a day at a time."""
    return shown(add_ewm_chunked(minutes(spark, sf), Ewm("ema_12", "cents", span(12)), F.to_date("dt")), "symbol", "dt", "ema_12", digits=3)


@query(
    "position_minutes",
    """
SELECT symbol, dt, position, position = 1 AND was = 0 AS entered, position = 0 AND was = 1 AS exited, peak
FROM (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY dt), 0) AS was
      FROM (SELECT symbol, dt, CASE WHEN last_value(nullif(signal, 0) IGNORE NULLS) OVER w = 1 THEN 1 ELSE 0 END AS position, max(cents) OVER w AS peak
            FROM minutes WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)))
""",
)
def position_minutes(spark, sf):
    """Positions and running peaks of minutes, a day at a time."""
    day = F.to_date("dt")
    held = add_position_chunked(minutes(spark, sf), day)
    return add_peak_chunked(held, day, value="cents").select("symbol", "dt", "position", "entered", "exited", "peak")


@query("rsi", "SELECT symbol, dt, round(rsi, 6) AS rsi FROM ewx")
def rsi(spark, sf):
    return shown(I.add_rsi(T.bars(spark, sf)), "symbol", "dt", "rsi")


@query(
    "macd",
    "SELECT symbol, dt, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_hist FROM ewx",
)
def macd(spark, sf):
    return shown(I.add_macd(T.bars(spark, sf)), "symbol", "dt", "macd", "macd_signal", "macd_hist")


@query("atr_ema", "SELECT symbol, dt, round(t20, 6) AS atr_ema FROM ewx")
def atr_ema(spark, sf):
    return shown(I.add_atr_ema(T.bars(spark, sf)), "symbol", "dt", "atr_ema")


cte(
    "kelt",
    f"""
SELECT symbol, dt, e20 AS km, e20 + 2.25 * a AS ku, e20 - 2.25 * a AS kl
FROM ewx JOIN (SELECT symbol, dt, {rl('avg', 'tr', 10)} AS a FROM tr) USING (symbol, dt)
""",
)


@query(
    "keltner",
    "SELECT symbol, dt, round(km, 6) AS keltner_mid, round(ku, 6) AS keltner_upper, round(kl, 6) AS keltner_lower FROM kelt",
)
def keltner(spark, sf):
    return shown(I.add_keltner(T.bars(spark, sf)), "symbol", "dt", "keltner_mid", "keltner_upper", "keltner_lower")


# ---- structure -------------------------------------------------------------------


def pivot_sql(source: str, p: int, time: str = "dt") -> str:
    """Pivots by comparing with each neighbour, unlike the Spark version's frames."""
    rng = [k for k in range(1, p + 1)]
    w = f"OVER (PARTITION BY symbol ORDER BY {time})"
    top = " AND ".join(f"high > lag(high, {k}) {w} AND high > lead(high, {k}) {w}" for k in rng)
    low = " AND ".join(f"low < lag(low, {k}) {w} AND low < lead(low, {k}) {w}" for k in rng)
    return f"SELECT *, CASE WHEN {top} THEN high END AS ph, CASE WHEN {low} THEN low END AS pl FROM {source}"


cte("piv", pivot_sql("b", 5))
cte(
    "levels",
    """
SELECT symbol, dt, side, price, row_number() OVER (PARTITION BY symbol, side ORDER BY dt DESC) AS k
FROM (SELECT symbol, dt, 'resistance' AS side, ph AS price FROM piv WHERE ph IS NOT NULL
      UNION ALL SELECT symbol, dt, 'support', pl FROM piv WHERE pl IS NOT NULL)
""",
)


@query("pivots", "SELECT symbol, dt, ph AS pivot_high, pl AS pivot_low FROM piv")
def pivots(spark, sf):
    return S.add_pivots(T.bars(spark, sf)).select("symbol", "dt", "pivot_high", "pivot_low")


@query("pivot_levels", "SELECT symbol, dt, side, price, CAST(k AS INTEGER) AS level_rank FROM levels WHERE k <= 5")
def pivot_levels(spark, sf):
    return S.pivot_levels(T.bars(spark, sf)).select("symbol", "dt", "side", "price", "level_rank")


cte(
    "fd_dev",
    """
SELECT x.symbol, x.dt, m.mean, m.sd, y.i,
       sum(y.close - m.mean) OVER (PARTITION BY x.symbol, x.dt ORDER BY y.i ROWS UNBOUNDED PRECEDING) AS cum
FROM b x
JOIN (SELECT symbol, dt, avg(close) OVER w AS mean, stddev_samp(close) OVER w AS sd FROM b
      WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) m
  ON m.symbol = x.symbol AND m.dt = x.dt
JOIN b y ON y.symbol = x.symbol AND y.i BETWEEN x.i - 30 AND x.i - 1
WHERE x.i >= 30
""",
)
cte(
    "fdv",
    """
SELECT symbol, dt, CASE WHEN max(cum) > min(cum) AND any_value(sd) > 0
       THEN 2 - least(greatest(ln((max(cum) - min(cum)) / any_value(sd)) / ln(30), 0), 1) ELSE 1.5 END AS fd
FROM fd_dev GROUP BY 1, 2
""",
)
cte(
    "regimes",
    """
SELECT symbol, dt, fd, CASE WHEN fd IS NULL THEN 'unknown' WHEN fd < 1.35 THEN 'trending' WHEN fd > 1.65 THEN 'choppy'
       ELSE 'transitional' END AS regime
FROM b LEFT JOIN fdv USING (symbol, dt)
""",
)


@query("fractal_dim", "SELECT symbol, dt, round(fd, 6) AS fd, regime FROM regimes")
def fractal_dim(spark, sf):
    p = S.add_fractal_dimension(T.bars(spark, sf)).withColumn("regime", S.market_regime(F.col("fd")))
    return shown(p, "symbol", "dt", "fd", "regime")


cte("wpiv", pivot_sql("weeks", 3, "wk"))
cte(
    "wk_final",
    """
SELECT symbol, CAST(coalesce(sign(max(CASE WHEN k = 1 THEN pl END) - max(CASE WHEN k = 2 THEN pl END)), 0) AS INTEGER) AS t
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY wk DESC) AS k FROM wpiv WHERE pl IS NOT NULL)
GROUP BY 1
""",
)
cte(
    "wk_known",
    """
SELECT w.symbol, w.wk, w.ph, w.pl, CAST(coalesce(sign(
  (SELECT arg_max(p.pl, p.wk) FROM wpiv3 p WHERE p.symbol = w.symbol AND p.confirmed <= w.wk)
  - (SELECT arg_max(p.prev, p.wk) FROM wpiv3 p WHERE p.symbol = w.symbol AND p.confirmed <= w.wk)), 0) AS INTEGER) AS t
FROM wpiv w
""",
)
cte(
    "wpiv3",
    """
SELECT *, lag(pl) OVER (PARTITION BY symbol ORDER BY wk) AS prev FROM
(SELECT symbol, wk, pl, lead(wk, 3) OVER (PARTITION BY symbol ORDER BY wk) AS confirmed FROM wpiv) WHERE pl IS NOT NULL
""",
)
cte(
    "daily_final",
    """
SELECT b.*, p.ph AS wph, p.pl AS wpl, CASE WHEN p.wk IS NULL THEN 0 ELSE coalesce(f.t, 0) END AS wt
FROM b ASOF LEFT JOIN wpiv p ON p.symbol = b.symbol AND p.wk <= b.dt LEFT JOIN wk_final f ON f.symbol = b.symbol
""",
)
cte(
    "daily_asof",
    """
SELECT b.*, p.ph AS wph, p.pl AS wpl, coalesce(p.t, 0) AS wt
FROM b ASOF LEFT JOIN wk_known p ON p.symbol = b.symbol AND p.wk <= b.dt
""",
)


@query(
    "weekly_trend_final",
    "SELECT symbol, dt, wph AS weekly_pivot_high, wpl AS weekly_pivot_low, CAST(wt AS INTEGER) AS weekly_trend FROM daily_final",
)
def weekly_trend_final(spark, sf):
    p = S.add_weekly_pivots(T.bars(spark, sf), trend="final")
    return p.select("symbol", "dt", "weekly_pivot_high", "weekly_pivot_low", "weekly_trend")


@query(
    "weekly_trend_asof",
    "SELECT symbol, dt, wph AS weekly_pivot_high, wpl AS weekly_pivot_low, CAST(wt AS INTEGER) AS weekly_trend FROM daily_asof",
)
def weekly_trend_asof(spark, sf):
    p = S.add_weekly_pivots(T.bars(spark, sf), trend="asof")
    return p.select("symbol", "dt", "weekly_pivot_high", "weekly_pivot_low", "weekly_trend")


cte(
    "events_all",
    """
SELECT symbol, dt, '52W High' AS event, high AS price, 1 AS pri
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY high DESC, dt) AS k FROM atr14 WHERE i >= n - 252) WHERE k = 1
UNION ALL
SELECT symbol, dt, '52W Low', low, 2
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY low, dt) AS k FROM atr14 WHERE i >= n - 252) WHERE k = 1
UNION ALL
SELECT symbol, dt, 'Gap', open, 3 FROM atr14 WHERE atr > 0 AND abs(open - pc) > 0.05 * atr
""",
)
cte(
    "events_top",
    """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY pri) AS first FROM events_all) WHERE first = 1
""",
)


@query("anchor_events", "SELECT symbol, dt, event, price, CAST(k AS INTEGER) AS event_rank FROM events_top WHERE k <= 5")
def anchor_events(spark, sf):
    return S.anchor_events(T.bars(spark, sf), gap_mult=0.05)


@query(
    "anchored_vwap",
    """
SELECT t.symbol, a.dt AS anchor_dt, t.dt, round(sum(tv) OVER v / (3 * sum(volume) OVER v), 6) AS anchored_vwap
FROM tp t JOIN (SELECT * FROM events_top WHERE k <= 5) a ON a.symbol = t.symbol AND t.dt >= a.dt
WINDOW v AS (PARTITION BY t.symbol, a.dt ORDER BY t.dt ROWS UNBOUNDED PRECEDING)
""",
)
def anchored_vwap(spark, sf):
    panel = T.bars(spark, sf)
    anchors = S.anchor_events(panel, gap_mult=0.05).withColumnRenamed("dt", "anchor_dt")
    return shown(I.anchored_vwap(panel, anchors), "symbol", "anchor_dt", "dt", "anchored_vwap")


cte(
    "vol_bins",
    """
SELECT symbol, lo, hi, CAST(least(49, greatest(0, floor((close - lo) / (hi - lo) * 50))) AS INTEGER) AS bin, sum(volume) AS v
FROM bars JOIN (SELECT symbol, min(low) AS lo, max(high) AS hi, count(*) AS k FROM bars GROUP BY 1) USING (symbol)
WHERE k >= 5 AND hi > lo GROUP BY 1, 2, 3, 4
""",
)
cte(
    "vol_grid",
    """
SELECT s.symbol, s.lo, s.hi, g.bin, coalesce(v.v, 0) AS v
FROM (SELECT DISTINCT symbol, lo, hi FROM vol_bins) s CROSS JOIN (SELECT unnest(range(50)) AS bin) g
LEFT JOIN vol_bins v ON v.symbol = s.symbol AND v.bin = g.bin
""",
)
cte(
    "va_rec",
    """
SELECT symbol, lo, hi, arg_max(bin, v * 100 - bin) AS a, arg_max(bin, v * 100 - bin) AS z, max(v) AS got, sum(v) AS total FROM vol_grid GROUP BY 1, 2, 3
UNION ALL
SELECT r.symbol, r.lo, r.hi,
       CASE WHEN down THEN a - 1 ELSE a END, CASE WHEN down THEN z ELSE z + 1 END,
       got + CASE WHEN down THEN below ELSE above END, total
FROM (SELECT r.*, coalesce(x.v, 0) AS below, coalesce(y.v, 0) AS above,
             r.a > 0 AND (coalesce(x.v, 0) >= coalesce(y.v, 0) OR r.z = 49) AS down
      FROM va_rec r LEFT JOIN vol_grid x ON x.symbol = r.symbol AND x.bin = r.a - 1
      LEFT JOIN vol_grid y ON y.symbol = r.symbol AND y.bin = r.z + 1
      WHERE r.got < r.total * 0.7::DOUBLE AND (r.a > 0 OR r.z < 49)) r
""",
)


@query("volume_profile", "SELECT symbol, bin, v AS volume FROM vol_bins")
def volume_profile(spark, sf):
    return S.volume_histogram(T.bars(spark, sf)).select("symbol", "bin", "volume")


@query(
    "value_area",
    """
SELECT symbol, round(lo + (poc + 0.5) * (hi - lo) / 50, 6) AS poc, round(lo + (z + 1) * (hi - lo) / 50, 6) AS value_area_high,
       round(lo + a * (hi - lo) / 50, 6) AS value_area_low, total AS total_volume
FROM (SELECT symbol, lo, hi, min(a) AS a, max(z) AS z, any_value(total) AS total FROM va_rec GROUP BY 1, 2, 3)
JOIN (SELECT symbol, arg_max(bin, v * 100 - bin) AS poc FROM vol_grid GROUP BY 1) USING (symbol)
""",
)
def value_area(spark, sf):
    return shown(S.volume_profile(T.bars(spark, sf)), "symbol", "poc", "value_area_high", "value_area_low", "total_volume")


cte(
    "contain_days",
    """
SELECT *, nc BETWEEN close - m AND close + m AS in1, nc BETWEEN close - 2 * m AND close + 2 * m AS in2
FROM (SELECT *, close * rv * sqrt(1::DOUBLE / 252) AS m, lead(close) OVER (PARTITION BY symbol ORDER BY dt) AS nc FROM rv_log)
WHERE i >= greatest(21, n - 60) AND i < n - 1 AND rv > 0
""",
)


@query(
    "containment_days",
    """
SELECT symbol, dt, close, nc AS next_close, round(rv, 4) AS rv, round(close - m, 2) AS range_low_1s, round(close + m, 2) AS range_high_1s,
       round(close - 2 * m, 2) AS range_low_2s, round(close + 2 * m, 2) AS range_high_2s, in1 AS in_1sigma, in2 AS in_2sigma
FROM contain_days
""",
)
def containment_days(spark, sf):
    return shown(S.containment_days(T.bars(spark, sf)), digits=2, rv=4, close=6, next_close=6)


@query(
    "containment",
    """
SELECT symbol, k AS days_tested, a AS containment_1sigma_pct, c AS containment_2sigma_pct,
       CASE WHEN abs(a - 68.3) + abs(c - 95.4) < 5 THEN 'A' WHEN abs(a - 68.3) + abs(c - 95.4) < 10 THEN 'B'
            WHEN abs(a - 68.3) + abs(c - 95.4) < 20 THEN 'C' ELSE 'D' END AS grade
FROM (SELECT symbol, count(*) AS k, round(avg(CASE WHEN in1 THEN 100.0 ELSE 0 END), 1) AS a,
             round(avg(CASE WHEN in2 THEN 100.0 ELSE 0 END), 1) AS c FROM contain_days GROUP BY 1)
""",
)
def containment(spark, sf):
    return S.containment(T.bars(spark, sf))


# ---- as-of joins -------------------------------------------------------------------


@query(
    "asof_vix",
    "SELECT b.symbol, b.dt, b.close, v.vix FROM bars b ASOF LEFT JOIN vix v ON v.dt <= b.dt",
)
def asof_vix(spark, sf):
    p = asof_calendar(T.bars(spark, sf), T.vix(spark, sf), ["vix"])
    return p.select("symbol", "dt", "close", "vix")


@query(
    "asof_weekly",
    "SELECT b.symbol, b.dt, b.close, w.close AS week_close FROM bars b ASOF LEFT JOIN weeks w ON w.symbol = b.symbol AND w.wk <= b.dt",
)
def asof_weekly(spark, sf):
    panel = T.bars(spark, sf)
    weeks = B.weekly_bars(panel).withColumnRenamed("close", "week_close")
    return asof_backward(panel, weeks, ["week_close"]).select("symbol", "dt", "close", "week_close")
