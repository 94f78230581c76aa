"""Score and screen queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import scores as C
from barloom.operators import screen as R

from . import tables as T
from .registry import query, rl, shown
from .sql import cte

cte(
    "snap_all",
    f"""
SELECT b.*, x.rsi, bb.mid, bb.sd, bb.upper, bb.lower, bb.bw, bm.bm, z.z, k.ku, k.kl, q.aq, v.vr, r.fd, r.regime, m.s50, m.s200,
       t.touches, t.dates, coalesce(v.vr > 1.5, false) AS surge
FROM b
JOIN ewx x ON x.symbol = b.symbol AND x.dt = b.dt
JOIN bb ON bb.symbol = b.symbol AND bb.dt = b.dt
JOIN (SELECT symbol, dt, coalesce({rl('min', 'bw', 20)}, bw) AS bm FROM bb) bm ON bm.symbol = b.symbol AND bm.dt = b.dt
JOIN zs z ON z.symbol = b.symbol AND z.dt = b.dt
JOIN kelt k ON k.symbol = b.symbol AND k.dt = b.dt
JOIN atr_q q ON q.symbol = b.symbol AND q.dt = b.dt
JOIN (SELECT symbol, dt, volume / {rl('avg', 'volume', 20)} AS vr FROM bars) v ON v.symbol = b.symbol AND v.dt = b.dt
JOIN regimes r ON r.symbol = b.symbol AND r.dt = b.dt
JOIN (SELECT symbol, dt, {rl('avg', 'close', 50)} AS s50, {rl('avg', 'close', 200)} AS s200 FROM bars) m ON m.symbol = b.symbol AND m.dt = b.dt
JOIN touch t ON t.symbol = b.symbol AND t.dt = b.dt
""",
)
cte(
    "touch",
    """
SELECT symbol, dt, count(CASE WHEN low <= lower THEN 1 END) OVER w AS touches,
       coalesce(string_agg(CASE WHEN low <= lower THEN CAST(dt AS VARCHAR) END, ',') OVER w, '') AS dates
FROM bb WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""",
)
cte("snap", "SELECT * FROM snap_all WHERE i = n - 1")
cte(
    "buys",
    """
SELECT *, coalesce(rsi < 30, false) AS oversold, coalesce(rsi < 30, false) AND touches >= 1 AS buy,
  round(CASE WHEN rsi < 30 THEN (30 - rsi) / 30 * 50 ELSE 0 END + least(touches / 5, 1) * 50, 1) AS strength
FROM snap
""",
)
cte(
    "sells",
    """
SELECT *, h + f + k + u AS active,
  round(least(100, CASE WHEN h = 1 THEN least(30, rsi - 70) ELSE 0 END + CASE WHEN f = 1 THEN least(30, (z - 2) * 15) ELSE 0 END
    + 20 * k + 20 * u), 1) AS sell_strength
FROM (SELECT *, CASE WHEN n >= 60 AND rsi > 70 THEN 1 ELSE 0 END AS h, CASE WHEN n >= 60 AND z > 2 THEN 1 ELSE 0 END AS f,
             CASE WHEN n >= 60 AND close >= ku THEN 1 ELSE 0 END AS k, CASE WHEN n >= 60 AND close >= upper THEN 1 ELSE 0 END AS u
      FROM buys)
""",
)
cte(
    "factors",
    """
SELECT *, round((fr / 25 * 0.25 + fz / 25 * 0.25 + fv / 15 * 0.15 + fg / 20 * 0.20 + fa / 15 * 0.15) * 100, 1) AS composite
FROM (SELECT *, CASE WHEN rsi < 30 THEN least(25, (30 - rsi) * 25 / 30) ELSE 0 END::DOUBLE AS fr,
  CASE WHEN z < -1 THEN least(25, abs(z) * 12.5) ELSE 0 END::DOUBLE AS fz,
  CASE WHEN vr > 1 THEN least(15, (vr - 1) * 15) ELSE 0 END::DOUBLE AS fv,
  CASE regime WHEN 'trending' THEN 20 WHEN 'transitional' THEN 10 WHEN 'choppy' THEN 3 ELSE 5 END::DOUBLE AS fg,
  CASE WHEN aq < 1 THEN least(15, (1 - aq) * 30) ELSE 0 END::DOUBLE AS fa,
  CASE WHEN aq < 0.7 THEN 'contracted' WHEN aq > 1.3 THEN 'expanded' ELSE 'normal' END AS atr_state
  FROM sells)
""",
)


@query(
    "buy_signal",
    """
SELECT symbol, dt, buy AS buy_signal, strength, oversold AS rsi_oversold, touches >= 1 AS touched_band, round(rsi, 2) AS rsi,
       round(close, 2) AS close, round(lower, 2) AS bb_lower, round(mid, 2) AS bb_mid, round(upper, 2) AS bb_upper, touches, dates AS touch_dates
FROM buys
""",
)
def buy_signal(spark, sf):
    out = C.buy_signal(T.bars(spark, sf))
    return out.withColumn("touch_dates", F.array_join(F.transform("touch_dates", lambda d: d.cast("string")), ","))


@query(
    "sell_signal",
    """
SELECT symbol, dt, h = 1 AS rsi_overbought, f = 1 AS zscore_extended, k = 1 AS above_keltner, u = 1 AS above_bb_upper,
       active AS active_count, active >= 2 AS sell_signal, sell_strength, round(rsi, 6) AS rsi, round(z, 6) AS zscore,
       round(upper, 4) AS bb_upper, round(ku, 4) AS keltner_upper
FROM sells
""",
)
def sell_signal(spark, sf):
    return shown(C.sell_signals(T.bars(spark, sf)), bb_upper=4, keltner_upper=4)


@query(
    "multi_factor",
    """
SELECT symbol, dt, composite AS composite_score, round(fr, 1) AS rsi_score, round(fz, 1) AS zscore_score, round(fv, 1) AS volume_score,
       round(fg, 1) AS regime_score, round(fa, 1) AS atr_score, vr > 1.5 AS volume_surge, regime, atr_state, round(z, 2) AS zscore
FROM factors
""",
)
def multi_factor(spark, sf):
    return C.multi_factor_score(T.bars(spark, sf))


cte(
    "opps_raw",
    """
SELECT *, CASE WHEN z < 0 THEN 'long' ELSE 'short' END AS lean, coalesce(s200, close) AS t200, (close - pc) / pc * 100 AS pct FROM snap
WHERE n >= 60
""",
)
cte(
    "opps",
    """
SELECT symbol, dt, close, 'Z-Score Mean Reversion' AS setup, CASE WHEN z < 0 THEN 'long' ELSE 'short' END AS direction, 1 AS tier,
       round(least(90, 50 + abs(z) * 20)) AS conf, 0 AS o, printf('z-score %.2f', z) AS reason FROM opps_raw WHERE abs(z) >= 1.5
UNION ALL SELECT symbol, dt, close, 'RSI Approaching Oversold', 'long', 1, round(60 + (35 - rsi) * 6), 2, printf('RSI %.1f', rsi) FROM opps_raw WHERE rsi BETWEEN 30 AND 35
UNION ALL SELECT symbol, dt, close, 'RSI Approaching Overbought', 'short', 1, round(60 + (rsi - 65) * 6), 3, printf('RSI %.1f', rsi) FROM opps_raw WHERE rsi BETWEEN 65 AND 70
UNION ALL SELECT symbol, dt, close, 'Bollinger Squeeze', lean, 1, 65, 4, 'bandwidth near its 20-bar low' FROM opps_raw WHERE bw > 0 AND bw <= bm * 1.05
UNION ALL SELECT symbol, dt, close, 'Trend Continuation', 'long', 2, 70, 5, printf('trending market, dimension %.2f', fd) FROM opps_raw WHERE regime = 'trending' AND close > s50 AND s50 > t200
UNION ALL SELECT symbol, dt, close, 'Trend Continuation', 'short', 2, 70, 6, printf('trending market, dimension %.2f', fd) FROM opps_raw WHERE regime = 'trending' AND close < s50 AND s50 < t200
UNION ALL SELECT symbol, dt, close, 'Volume Breakout', 'long', 2, round(55 + least(20, vr * 5)), 7, printf('%.1f%% on %.1f times the usual volume', pct, vr) FROM opps_raw WHERE vr > 1.5 AND pct > 0.5
UNION ALL SELECT symbol, dt, close, 'Volume Breakdown', 'short', 2, round(55 + least(20, vr * 5)), 8, printf('%.1f%% on %.1f times the usual volume', pct, vr) FROM opps_raw WHERE vr > 1.5 AND pct < -0.5
UNION ALL SELECT symbol, dt, close, 'ATR Contraction (Coiled Spring)', lean, 2, 60, 9, printf('ATR at %.0f%% of its 60-bar mean', aq * 100) FROM opps_raw WHERE aq < 0.7
UNION ALL SELECT symbol, dt, close, 'Regime Mean Reversion', lean, 2, 65, 10, printf('choppy market, dimension %.2f', fd) FROM opps_raw WHERE regime = 'choppy' AND abs(z) > 1
UNION ALL SELECT symbol, dt, close, CASE WHEN s50 > t200 THEN 'Golden Cross Imminent' ELSE 'Death Cross Imminent' END,
  CASE WHEN s50 > t200 THEN 'long' ELSE 'short' END, 3, 45, 11, 'averages within 1%' FROM opps_raw WHERE abs((s50 - t200) / t200) < 0.01
""",
)


@query(
    "opportunities",
    """
SELECT symbol, dt, close, setup, direction, tier, CAST(conf AS INTEGER) AS confidence, reason,
       CAST(row_number() OVER (PARTITION BY symbol ORDER BY tier, conf DESC, o) AS INTEGER) AS setup_rank
FROM opps
""",
)
def opportunities(spark, sf):
    return C.opportunities(T.bars(spark, sf))


@query(
    "conflicts",
    "SELECT symbol, count(DISTINCT direction) > 1 AS conflicted, count(*) AS setups FROM opps GROUP BY 1",
)
def conflicts(spark, sf):
    return C.conflicts(C.opportunities(T.bars(spark, sf)))


cte(
    "votes6",
    """
SELECT s.symbol, s.dt, CASE WHEN s.s50 > s.s200 THEN 1 ELSE -1 END AS a,
       CASE WHEN u.buy THEN 1 WHEN round(s.rsi, 2) > 70 THEN -1 ELSE 0 END AS b,
       m.signal AS c, q.signal AS d, t.signal AS e, u2.signal AS f
FROM snap s JOIN buys u ON u.symbol = s.symbol
JOIN sig_macd m ON m.symbol = s.symbol AND m.dt = s.dt JOIN sig_bb q ON q.symbol = s.symbol AND q.dt = s.dt
JOIN sig_ts t ON t.symbol = s.symbol AND t.dt = s.dt JOIN sig_tu u2 ON u2.symbol = s.symbol AND u2.dt = s.dt
""",
)
cte(
    "cons",
    """
SELECT *, CASE WHEN up >= 3 THEN 'bullish' WHEN dn >= 3 THEN 'bearish' ELSE 'mixed' END AS consensus
FROM (SELECT *, len(list_filter([a, b, c, d, e, f], lambda v: v > 0)) AS up, len(list_filter([a, b, c, d, e, f], lambda v: v < 0)) AS dn FROM votes6)
""",
)


@query(
    "consensus",
    """
SELECT symbol, dt, a AS vote_ma, b AS vote_rsi_bb, c AS vote_macd_rsi, d AS vote_squeeze, e AS vote_tsmom, f AS vote_turtle,
       CAST(up AS INTEGER) AS bullish_count, CAST(dn AS INTEGER) AS bearish_count, CAST(6 - up - dn AS INTEGER) AS neutral_count, consensus
FROM cons
""",
)
def consensus(spark, sf):
    return C.strategy_consensus(T.bars(spark, sf))


cte(
    "conf",
    """
SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END + CASE WHEN z <= -2 THEN 1 WHEN z >= 2 THEN -1 ELSE 0 END
  + CASE WHEN close <= kl THEN 1 WHEN close >= ku THEN -1 ELSE 0 END + CASE WHEN ns THEN 1 ELSE 0 END - CASE WHEN nr THEN 1 ELSE 0 END
  + CASE WHEN surge THEN CAST(sign(close - open) AS INTEGER) ELSE 0 END AS score
FROM (SELECT s.*, EXISTS (SELECT 1 FROM levels l WHERE l.k <= 5 AND l.symbol = s.symbol AND side = 'support' AND abs(s.close - l.price) / s.close < 0.01) AS ns,
             EXISTS (SELECT 1 FROM levels l WHERE l.k <= 5 AND l.symbol = s.symbol AND side = 'resistance' AND abs(s.close - l.price) / s.close < 0.01) AS nr
      FROM snap_all s)
""",
)


@query(
    "confluence",
    """
SELECT symbol, dt, coalesce(rsi < 30, false) AS rsi_buy, coalesce(rsi > 70, false) AS rsi_sell, coalesce(z <= -2, false) AS zscore_buy,
       coalesce(z >= 2, false) AS zscore_sell, coalesce(close <= kl, false) AS keltner_buy, coalesce(close >= ku, false) AS keltner_sell,
       ns AS fractal_buy, nr AS fractal_sell, surge AS volume_surge, score AS signal_score,
       CASE WHEN score >= 2 THEN 'strong_buy' WHEN score = 1 THEN 'buy' WHEN score = 0 THEN 'neutral' WHEN score = -1 THEN 'sell'
            ELSE 'strong_sell' END AS signal_label
FROM conf
""",
)
def confluence(spark, sf):
    return C.confluence(T.bars(spark, sf))


cte(
    "scan_rows",
    """
SELECT f.*, c.a, c.b, c.c, c.d, c.e, c.f AS g, c.up, c.dn, c.consensus, x.dt AS xdt, x.signal AS xs, x.close AS xp,
  CASE WHEN buy THEN 'buy' WHEN active >= 2 THEN 'sell' WHEN oversold THEN 'watch' ELSE 'none' END AS bucket
FROM factors f JOIN cons c ON c.symbol = f.symbol
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS r FROM sig_ma WHERE signal <> 0) x ON x.symbol = f.symbol AND x.r = 1
WHERE f.n >= 200
""",
)


@query(
    "scan_full",
    """
SELECT symbol, dt, round(close, 2) AS price, round(rsi, 2) AS rsi, buy AS buy_signal, strength, oversold AS rsi_oversold, touches,
       CASE WHEN s50 > s200 THEN 'bullish' ELSE 'bearish' END AS ma_trend, xdt AS cross_dt, CASE xs WHEN 1 THEN 'golden_cross' WHEN -1 THEN 'death_cross' END AS cross_type,
       xp AS cross_price, composite AS composite_score, regime, atr_state, active >= 2 AS sell_signal, sell_strength, consensus,
       (SELECT count(*) FROM opps o WHERE o.symbol = s.symbol) AS setups
FROM scan_rows s
""",
)
def scan_full(spark, sf):
    r = R.scan(T.bars(spark, sf))
    return r.select(
        "symbol", "dt", "price", "rsi", "buy_signal", "strength", "rsi_oversold", "touches", "ma_trend", "cross.cross_dt",
        "cross.cross_type", "cross.cross_price", "composite_score", "regime", "atr_state", "sell_signal", "sell_strength",
        "consensus", F.size("setups").cast("bigint").alias("setups"),
    )


@query(
    "scan_buckets",
    """
SELECT symbol, bucket, CASE bucket WHEN 'watch' THEN round(rsi, 2) WHEN 'sell' THEN -sell_strength ELSE -composite END AS sort_key FROM scan_rows
""",
)
def scan_buckets(spark, sf):
    return R.bucket_list(R.scan(T.bars(spark, sf))).select("symbol", "bucket", "sort_key")


@query("scan_bucket_counts", "SELECT bucket, count(*) AS symbols FROM scan_rows GROUP BY 1")
def scan_bucket_counts(spark, sf):
    return R.bucket_counts(R.scan(T.bars(spark, sf)))


@query(
    "setup_list",
    """
SELECT o.symbol, round(o.close, 2) AS price, setup, direction, tier, CAST(conf AS INTEGER) AS confidence, reason,
       CAST(row_number() OVER (PARTITION BY o.symbol ORDER BY tier, conf DESC, o) AS INTEGER) AS setup_rank
FROM opps o JOIN scan_rows s ON s.symbol = o.symbol
""",
)
def setup_list(spark, sf):
    return R.setup_list(R.scan(T.bars(spark, sf)))


@query(
    "factor_table",
    """
SELECT symbol, round(close, 2) AS price, round(rsi, 2) AS rsi, bucket, round(fr, 1) AS rsi_score, round(z, 2) AS zscore, round(fz, 1) AS zscore_score,
       round(fv, 1) AS volume_score, regime, round(fg, 1) AS regime_score, round(fa, 1) AS atr_score, composite AS composite_score
FROM scan_rows
""",
)
def factor_table(spark, sf):
    return R.factor_table(R.scan(T.bars(spark, sf)))


@query(
    "watchlist_scan",
    """
SELECT symbol, bucket, CASE WHEN buy THEN -strength ELSE round(rsi, 2) END AS sort_key, round(rsi, 2) AS rsi, strength
FROM scan_rows s WHERE (buy OR oversold) AND symbol IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)
""",
)
def watchlist_scan(spark, sf):
    listed = T.table(spark, sf, "supplier").filter("s_acctbal > 0")
    listed = listed.select(F.col("s_suppkey").cast("string").alias("symbol"))
    out = R.watchlist_scan(T.bars(spark, sf), listed)
    return out.select("symbol", "bucket", "sort_key", "rsi", "strength")


cte(
    "wb",
    """
SELECT symbol, wk AS dt, open, high, low, close, volume, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER w AS pc
FROM weeks WINDOW w AS (PARTITION BY symbol ORDER BY wk)
""",
)
cte(
    "wew",
    """
SELECT symbol, i, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM wb WHERE i = 0
UNION ALL
SELECT t.symbol, t.i, CASE WHEN e.g IS NULL THEN greatest(t.close - t.pc, 0) ELSE e.g + (greatest(t.close - t.pc, 0) - e.g) / 14 END,
       CASE WHEN e.l IS NULL THEN greatest(t.pc - t.close, 0) ELSE e.l + (greatest(t.pc - t.close, 0) - e.l) / 14 END
FROM wew e JOIN wb t ON t.symbol = e.symbol AND t.i = e.i + 1
""",
)
cte(
    "wsnap",
    f"""
SELECT *, round(CASE WHEN rsi < 30 THEN (30 - rsi) / 30 * 50 ELSE 0 END + least(touches / 5, 1) * 50, 1) AS strength
FROM (SELECT x.*, CASE WHEN x.i >= 14 AND e.l > 0 THEN 100 - 100 / (1 + e.g / e.l) END AS rsi,
             count(CASE WHEN low <= mid - 2 * sd THEN 1 END) OVER (PARTITION BY x.symbol ORDER BY x.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS touches
      FROM (SELECT *, {rl('avg', 'close', 20)} AS mid, {rl('stddev_samp', 'close', 20)} AS sd FROM wb) x JOIN wew e ON e.symbol = x.symbol AND e.i = x.i)
WHERE i = n - 1 AND n >= 20 AND rsi < 38
""",
)
@query(
    "screen_weekly",
    """
SELECT w.symbol, round(strength * 0.6 + coalesce(round(m.wr * 100, 2), 0) * 0.4, 1) AS score, round(close, 2) AS price, round(rsi, 2) AS rsi, strength,
       rsi < 30 AND touches >= 1 AS buy_signal, rsi < 30 AS rsi_oversold, touches, round(w.mid - 2 * w.sd, 2) AS bb_lower, round(w.mid, 2) AS bb_mid,
       round(w.mid + 2 * w.sd, 2) AS bb_upper, round(coalesce(round(m.wr * 100, 2), 0), 1) AS win_rate, coalesce(m.nt, 0) AS num_trades, coalesce(round(m.tot, 2), 0) AS bt_return
FROM wsnap w LEFT JOIN ma_ratio m ON m.symbol = w.symbol ORDER BY score DESC, w.symbol LIMIT 15
""",
)
def screen_weekly(spark, sf):
    return R.weekly_screen(T.bars(spark, sf))
