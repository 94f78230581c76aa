"""Signals, positions, trades, equity and metrics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import backtest as K
from barloom.operators import bars as B
from barloom.operators import signals as G
from barloom.operators.indicators import add_drawdown, add_rolling_sharpe
from barloom.plans.backtest import backtest

from . import tables as T
from .registry import query, rl, shown
from .sql import cte

UP = "ROWS UNBOUNDED PRECEDING"

# ---- signals --------------------------------------------------------------------

cte(
    "sig_ma",
    f"""
SELECT *, CASE WHEN a > coalesce(lag(a) OVER (PARTITION BY symbol ORDER BY dt), a) THEN 1
               WHEN a < coalesce(lag(a) OVER (PARTITION BY symbol ORDER BY dt), a) THEN -1 ELSE 0 END AS signal
FROM (SELECT *, CASE WHEN {rl('avg', 'close', 50)} > {rl('avg', 'close', 200)} THEN 1 ELSE 0 END AS a FROM b)
""",
)
cte(
    "sig_macd",
    """
SELECT symbol, dt, i, CASE
  WHEN (macd < sig AND pm >= ps) OR rsi > 65 THEN -1 WHEN macd > sig AND pm <= ps AND rsi < 45 THEN 1 ELSE 0 END AS signal
FROM (SELECT *, lag(macd) OVER w AS pm, lag(sig) OVER w AS ps FROM ewx WINDOW w AS (PARTITION BY symbol ORDER BY dt))
""",
)
cte(
    "squeeze",
    """
SELECT *, coalesce(upper < e20 + 1.5 * t20 AND lower > e20 - 1.5 * t20, false) AS sq
FROM bb JOIN (SELECT symbol, dt, e20, t20 FROM ewx) USING (symbol, dt)
""",
)
cte(
    "sig_bb",
    """
SELECT symbol, dt, i, sq, coalesce(lag(sq) OVER (PARTITION BY symbol ORDER BY dt), false) AND NOT sq AS release,
  CASE WHEN close < mid THEN -1
       WHEN coalesce(lag(sq) OVER (PARTITION BY symbol ORDER BY dt), false) AND NOT sq AND close > upper THEN 1 ELSE 0 END AS signal
FROM squeeze
""",
)
cte(
    "sig_ts",
    """
SELECT symbol, dt, i, CAST(sign(
  CASE WHEN l21 IS NULL THEN 0 ELSE -1 END
  + CASE WHEN l63 IS NULL THEN 0 WHEN l21 > l63 THEN 1 ELSE -1 END
  + CASE WHEN l126 IS NULL THEN 0 WHEN l21 > l126 THEN 1 ELSE -1 END
  + CASE WHEN l252 IS NULL THEN 0 WHEN l21 > l252 THEN 1 ELSE -1 END) AS INTEGER) AS signal
FROM (SELECT *, lag(close, 21) OVER w AS l21, lag(close, 63) OVER w AS l63, lag(close, 126) OVER w AS l126,
             lag(close, 252) OVER w AS l252 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY dt))
""",
)
cte(
    "sig_tu",
    "SELECT symbol, dt, i, CASE WHEN low < dl THEN -1 WHEN high > dh THEN 1 ELSE 0 END AS signal FROM donchian",
)


def fractal_bits(weekly: str) -> str:
    """Entry and exit conditions of the fractal rule, pivots looked up by as-of join."""
    return f"""
SELECT x.*, fd.fd, s.sma,
  x.i >= 40 AND lo.i IS NOT NULL AND x.i - 5 - lo.i <= 5 AND fd.fd < 1.40 AND x.close > lo.pl AND x.wt >= 0 AND x.close > s.sma AS e,
  x.i >= 40 AND (coalesce(x.close < lo.pl, false) OR coalesce(fd.fd > 1.55, false)
     OR coalesce(hi.i = x.i - 5 AND x.close < hi.ph, false)) AS q
FROM {weekly} x
ASOF LEFT JOIN (SELECT symbol, i, pl FROM piv WHERE pl IS NOT NULL) lo ON lo.symbol = x.symbol AND lo.i <= x.i - 5
ASOF LEFT JOIN (SELECT symbol, i, ph FROM piv WHERE ph IS NOT NULL) hi ON hi.symbol = x.symbol AND hi.i <= x.i - 5
LEFT JOIN fdv fd ON fd.symbol = x.symbol AND fd.dt = x.dt
LEFT JOIN (SELECT symbol, dt, {rl('avg', 'close', 50)} AS sma FROM bars) s ON s.symbol = x.symbol AND s.dt = x.dt
"""


def machine(source: str) -> str:
    """The in/out machine stepped bar by bar."""
    name = source + "_st"
    return f"""
SELECT symbol, dt, i, 0 AS signal, 0 AS st FROM {source} WHERE i = 0
UNION ALL
SELECT x.symbol, x.dt, x.i,
  CASE WHEN r.st = 0 AND coalesce(x.e, false) THEN 1 WHEN r.st = 1 AND coalesce(x.q, false) THEN -1 ELSE 0 END,
  CASE WHEN r.st = 0 AND coalesce(x.e, false) THEN 1 WHEN r.st = 1 AND coalesce(x.q, false) THEN 0 ELSE r.st END
FROM {name} r JOIN {source} x ON x.symbol = r.symbol AND x.i = r.i + 1
"""


for mode in ("asof", "final"):
    cte(f"fr_{mode}", fractal_bits(f"daily_{mode}"))
    cte(f"fr_{mode}_st", machine(f"fr_{mode}"))

cte(
    "sigs6",
    """
SELECT symbol, dt, i, signal, 'MA Crossover' AS strategy FROM sig_ma
UNION ALL SELECT symbol, dt, i, signal, 'MACD + RSI' FROM sig_macd
UNION ALL SELECT symbol, dt, i, signal, 'BB Squeeze' FROM sig_bb
UNION ALL SELECT symbol, dt, i, signal, 'TSMOM' FROM sig_ts
UNION ALL SELECT symbol, dt, i, signal, 'Turtle' FROM sig_tu
UNION ALL SELECT symbol, dt, i, signal, 'Fractal' FROM fr_asof_st
""",
)


def in_position(source: str, part: str) -> str:
    """1 while the last decisive signal was an entry: entries counted since the last exit."""
    return f"""
SELECT *, CASE WHEN count(CASE WHEN signal = 1 THEN 1 END) OVER (PARTITION BY {part}, _g ORDER BY dt {UP}) > 0 THEN 1 ELSE 0 END AS pos
FROM (SELECT *, count(CASE WHEN signal = -1 THEN 1 END) OVER (PARTITION BY {part} ORDER BY dt {UP}) AS _g FROM {source})
"""


cte("pos6", in_position("sigs6", "symbol, strategy"))
cte("votes", "SELECT symbol, dt, i, CAST(sum(pos) AS INTEGER) AS v FROM pos6 GROUP BY 1, 2, 3")
cte("ens", "SELECT *, v >= 3 AS e, v < 2 AS q FROM votes")
cte("ens_st", machine("ens").replace("0 AS signal, 0 AS st", "CASE WHEN e THEN 1 ELSE 0 END AS signal, CASE WHEN e THEN 1 ELSE 0 END AS st"))
cte(
    "sigs",
    """
SELECT s.symbol, s.strategy, s.dt, b.close, s.signal FROM
(SELECT symbol, dt, signal, strategy FROM sigs6 UNION ALL SELECT symbol, dt, signal, 'Ensemble' FROM ens_st) s
JOIN b ON b.symbol = s.symbol AND b.dt = s.dt
WHERE b.n >= CASE WHEN s.strategy IN ('MA Crossover', 'TSMOM') THEN 252 ELSE 60 END
""",
)


@query("ma_signal", "SELECT symbol, dt, CAST(signal AS INTEGER) AS signal FROM sig_ma")
def ma_signal(spark, sf):
    return G.ma_crossover(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query(
    "ma_state",
    f"""
SELECT f.symbol, CASE WHEN f.a = 1 THEN 'bullish' ELSE 'bearish' END AS trend, round(f.s50, 6) AS sma_short, round(f.s200, 6) AS sma_long,
       CASE x.signal WHEN 1 THEN 'golden_cross' WHEN -1 THEN 'death_cross' END AS cross_type, x.dt AS cross_dt, round(x.close, 2) AS cross_price
FROM (SELECT *, {rl('avg', 'close', 50)} AS s50, {rl('avg', 'close', 200)} AS s200 FROM sig_ma) f
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM sig_ma WHERE signal <> 0) x
  ON x.symbol = f.symbol AND x.k = 1
WHERE f.i = f.n - 1
""",
)
def ma_state(spark, sf):
    return G.last_cross(T.bars(spark, sf), digits=6)


_DECIMAL = "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY dt) % 97 < 60 THEN 101.37 ELSE round(close * 1.0137, 3) END"


def _mean(n: int) -> str:
    """The mean of n values; of equal values that value."""
    f = f"OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {f} < {n} THEN NULL WHEN min(c) {f} = max(c) {f} THEN min(c) {f} ELSE avg(c) {f} END"


cte("decimal_bars", f"SELECT symbol, dt, CAST({_DECIMAL} AS DOUBLE) AS c FROM bars")
cte(
    "decimal_above",
    f"""
SELECT symbol, dt, CASE WHEN a > b THEN 1 ELSE 0 END AS above
FROM (SELECT symbol, dt, {_mean(20)} AS a, {_mean(50)} AS b FROM decimal_bars)
""",
)


@query(
    "ma_signal_decimal",
    """
SELECT symbol, dt, CAST(coalesce(above - lag(above) OVER (PARTITION BY symbol ORDER BY dt), 0) AS INTEGER) AS signal FROM decimal_above
""",
)
def ma_signal_decimal(spark, sf):
    """Crossovers of prices that are no binary fractions, with flat stretches in between: a flat stretch has none."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("dt"))
    price = F.when(place % 97 < 60, 101.37).otherwise(F.round(F.col("close") * 1.0137, 3))
    return G.ma_crossover(T.bars(spark, sf).withColumn("close", price), 20, 50).select("symbol", "dt", "signal")


@query("sig_macd_rsi", "SELECT symbol, dt, signal FROM sig_macd")
def sig_macd_rsi(spark, sf):
    return G.macd_rsi(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query("sig_squeeze", "SELECT symbol, dt, signal FROM sig_bb")
def sig_squeeze(spark, sf):
    return G.bb_squeeze(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query("squeeze_state", "SELECT symbol, dt, sq AS squeeze_on, release AS squeeze_release FROM sig_bb")
def squeeze_state(spark, sf):
    from barloom.operators.indicators import add_squeeze

    return add_squeeze(T.bars(spark, sf)).select("symbol", "dt", "squeeze_on", "squeeze_release")


@query("sig_tsmom", "SELECT symbol, dt, signal FROM sig_ts")
def sig_tsmom(spark, sf):
    return G.tsmom(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query("sig_turtle", "SELECT symbol, dt, signal FROM sig_tu")
def sig_turtle(spark, sf):
    return G.turtle(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query("sig_fractal", "SELECT symbol, dt, signal FROM fr_asof_st")
def sig_fractal(spark, sf):
    return G.fractal(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query("sig_fractal_final", "SELECT symbol, dt, signal FROM fr_final_st")
def sig_fractal_final(spark, sf):
    return G.fractal(T.bars(spark, sf), weekly_trend="final").select("symbol", "dt", "signal")


@query(
    "ensemble_votes",
    "SELECT symbol, dt, v AS votes_buy, 6 - v AS votes_sell, round(v / 6.0, 6) AS confidence FROM votes",
)
def ensemble_votes(spark, sf):
    return shown(G.ensemble_votes(T.bars(spark, sf)), "symbol", "dt", "votes_buy", "votes_sell", "confidence")


@query("sig_ensemble", "SELECT symbol, dt, signal FROM ens_st")
def sig_ensemble(spark, sf):
    return G.ensemble(T.bars(spark, sf)).select("symbol", "dt", "signal")


@query("signals_all", "SELECT symbol, strategy, dt, signal FROM sigs")
def signals_all(spark, sf):
    return G.compute_signals(T.bars(spark, sf)).select("symbol", "strategy", "dt", "signal")


cte("vix_d", "SELECT symbol, b.dt, v.vix FROM bars b ASOF LEFT JOIN vix v ON v.dt <= b.dt")
cte(
    "vix_r",
    """
SELECT *, CASE WHEN vix IS NULL THEN 'unknown' WHEN vix < 15 THEN 'low_vol' WHEN vix < 25 THEN 'normal'
               WHEN vix < 35 THEN 'elevated' ELSE 'crisis' END AS regime FROM vix_d
""",
)


@query(
    "vix_filter",
    """
SELECT s.symbol, s.dt, s.signal, v.vix, v.regime AS vix_regime,
       CASE WHEN s.signal = 1 AND v.regime IN ('crisis', 'elevated') THEN 0 ELSE s.signal END AS filtered_signal
FROM sig_tu s JOIN vix_r v ON v.symbol = s.symbol AND v.dt = s.dt
""",
)
def vix_filter(spark, sf):
    out = G.vix_filter(G.turtle(T.bars(spark, sf)), T.vix(spark, sf))
    return out.select("symbol", "dt", "signal", "vix", "vix_regime", "filtered_signal")


@query(
    "size_multiplier",
    """
SELECT dt, vix, CASE WHEN vix < 25 THEN 1.0 WHEN vix < 35 THEN 0.5 ELSE 0.0 END::DOUBLE AS size_multiplier FROM vix
""",
)
def size_multiplier(spark, sf):
    return T.vix(spark, sf).select("dt", "vix", G.size_multiplier(F.col("vix")).alias("size_multiplier"))


# ---- positions, trades, equity ------------------------------------------------------

cte("sig_ma_s", "SELECT symbol, 'MA Crossover' AS strategy, dt, close, signal FROM sig_ma WHERE n >= 252")


def book_sql(source: str, fee: float, fraction: str, initial: int = 10000) -> dict[str, str]:
    """Position, trade number and equity, from a join of bars with the trade list."""
    key = "symbol, strategy"
    return {
        "pos": in_position(source, key),
        "mv": f"""
SELECT *, pos = 1 AND coalesce(lag(pos) OVER w, 0) = 0 AS ent, pos = 0 AND coalesce(lag(pos) OVER w, 0) = 1 AS ext,
       row_number() OVER w - 1 AS j, first_value(close) OVER w AS c0
FROM @pos WINDOW w AS (PARTITION BY {key} ORDER BY dt)
""",
        "tn": f"SELECT *, count(CASE WHEN ent THEN 1 END) OVER (PARTITION BY {key} ORDER BY dt {UP}) AS t FROM @mv",
        "tr": f"""
SELECT {key}, t, max(CASE WHEN ent THEN dt END) AS d0, max(CASE WHEN ent THEN close END) AS p0,
       max(CASE WHEN ext THEN dt END) AS d1, max(CASE WHEN ext THEN close END) AS p1,
       max(CASE WHEN ent THEN {fraction} END) AS f
FROM @tn WHERE t > 0 GROUP BY ALL
""",
        "cap": f"""
SELECT *, {initial} * coalesce(product(1 - f + f * (1 - {fee}) * (1 - {fee}) * coalesce(p1 / p0, 1)) OVER
  (PARTITION BY {key} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before,
  {initial} * product(1 - f + f * (1 - {fee}) * (1 - {fee}) * coalesce(p1 / p0, 1)) OVER
  (PARTITION BY {key} ORDER BY t {UP}) AS after
FROM @tr
""",
        "eq": f"""
SELECT x.*, c.d0, c.p0, c.f, {initial} * x.close / x.c0 AS bh,
  CASE WHEN x.t = 0 THEN {initial} WHEN x.pos = 1 THEN c.before * (1 - c.f + c.f * (1 - {fee}) * x.close / c.p0) ELSE c.after END AS eq,
  CASE WHEN x.t = 0 THEN {initial} WHEN x.pos = 1 THEN c.before * (1 - c.f + c.f * (1 - {fee}) * (1 - {fee}) * x.close / c.p0) ELSE c.after END AS fin,
  CASE WHEN x.ext THEN round((x.close - c.p0) / c.p0 * 100, 2) END AS pnl,
  CASE WHEN x.ext THEN x.dt - c.d0 END AS dur
FROM @tn x LEFT JOIN @cap c ON c.symbol = x.symbol AND c.strategy = x.strategy AND c.t = x.t
""",
    }


def add_book(prefix: str, source: str, fee: float = 0.0, fraction: str = "1.0::DOUBLE") -> None:
    for part, body in book_sql(source, fee, fraction).items():
        cte(f"{prefix}_{part}", body.replace("@", f"{prefix}_"))


add_book("ma", "sig_ma_s")


@query("position", "SELECT symbol, dt, CAST(signal AS INTEGER) AS signal, pos AS position FROM ma_pos")
def position(spark, sf):
    s = G.compute_signals(T.bars(spark, sf), ["MA Crossover"])
    return K.add_position(s).select("symbol", "dt", "signal", "position")


TRADE_SQL = """
SELECT symbol, strategy, t AS trade_no, d0 AS entry_dt, round(p0, 2) AS entry_price,
       round(before * f * (1 - {fee}) / p0, 4) AS shares, d1 AS exit_dt, round(p1, 2) AS exit_price,
       round((p1 - p0) / p0 * 100, 2) AS pnl_pct, CAST(d1 - d0 AS INTEGER) AS duration_days
FROM {p}_cap
"""


@query("trades_ma", TRADE_SQL.format(p="ma", fee=0.0))
def trades_ma(spark, sf):
    return K.round_trips(K.equity_curve(G.compute_signals(T.bars(spark, sf), ["MA Crossover"])))


@query("equity_ma", "SELECT symbol, dt, pos AS position, round(eq, 4) AS equity, round(bh, 4) AS buy_hold FROM ma_eq")
def equity_ma(spark, sf):
    c = K.equity_curve(G.compute_signals(T.bars(spark, sf), ["MA Crossover"]))
    return shown(c, "symbol", "dt", "position", "equity", "buy_hold", digits=4)


def metrics_ctes(p: str) -> None:
    """Metrics from an equity CTE; streaks and drawdown lengths by gaps and islands."""
    key = "symbol, strategy"
    w = f"(PARTITION BY {key} ORDER BY dt {UP})"
    cte(f"{p}_day", f"""
SELECT *, eq / lag(eq) OVER (PARTITION BY {key} ORDER BY dt) - 1 AS r, max(eq) OVER {w} AS pk,
       arg_max(eq, dt) OVER (PARTITION BY {key}) AS e1, arg_min(eq, dt) OVER (PARTITION BY {key}) AS e0
FROM {p}_eq
""")
    cte(f"{p}_isl", f"""
SELECT {key}, win, count(*) AS len FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY dt) - row_number() OVER (PARTITION BY {key}, win ORDER BY dt) AS g
  FROM (SELECT {key}, dt, pnl > 0 AS win FROM {p}_eq WHERE pnl IS NOT NULL)) GROUP BY {key}, win, g
""")
    cte(f"{p}_ddl", f"""
SELECT {key}, max(len) AS len FROM (SELECT {key}, g, count(*) AS len FROM (
  SELECT *, j - row_number() OVER (PARTITION BY {key} ORDER BY dt) AS g FROM {p}_day WHERE eq < pk) GROUP BY {key}, g)
GROUP BY {key}
""")
    cte(f"{p}_agg", f"""
SELECT {key}, count(*) AS bars, (arg_max(fin, dt) - 10000) / 10000 * 100 AS tot, arg_max(fin, dt) AS fin,
  (arg_max(bh, dt) - 10000) / 10000 * 100 AS bhr, min((eq - pk) / pk) * 100 AS mdd, count(r) AS nr, avg(r) AS mean,
  stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS down,
  (pow(any_value(e1) / any_value(e0), 365.25 / greatest(max(dt) - min(dt), 1)) - 1) * 100 AS ann,
  count(pnl) AS nt, count(CASE WHEN pnl > 0 THEN 1 END) AS nw, count(CASE WHEN pnl <= 0 THEN 1 END) AS nl,
  coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS gw, coalesce(abs(sum(CASE WHEN pnl <= 0 THEN pnl END)), 0) AS gl,
  coalesce(avg(dur), 0) AS ad
FROM {p}_day GROUP BY {key}
""")
    cte(f"{p}_ratio", f"""
SELECT *, CASE WHEN nw > 0 THEN gw / nw ELSE 0 END AS aw, CASE WHEN nl > 0 THEN gl / nl ELSE 0 END AS al,
  CASE WHEN nt > 0 THEN nw / nt ELSE 0 END AS wr,
  CASE WHEN gl > 0 THEN (CASE WHEN nw > 0 THEN gw / nw ELSE 0 END) / (gl / nl) ELSE 0 END AS pay
FROM {p}_agg
""")


METRICS_SQL = """
SELECT a.symbol, a.strategy, bars, round(fin, 6) AS final_capital, round(tot, 6) AS total_return_pct,
  CASE WHEN nr > 1 THEN round(ann, 6) END AS annualized_return_pct, round(bhr, 6) AS buy_hold_return_pct,
  round(tot - bhr, 6) AS alpha_pct, round(mdd, 6) AS max_drawdown_pct,
  round(CASE WHEN nr > 1 AND sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END, 6) AS sharpe_ratio,
  round(CASE WHEN nr > 1 AND down > 0 THEN mean / down * sqrt(252) ELSE 0 END, 6) AS sortino_ratio,
  round(CASE WHEN nr > 1 AND mdd <> 0 THEN ann / abs(mdd) ELSE 0 END, 6) AS calmar_ratio,
  round(CASE WHEN gl > 0 THEN gw / gl WHEN gw = 0 THEN 0 END, 6) AS profit_factor, gl = 0 AND gw > 0 AS no_losses,
  nt AS num_trades, round(wr * 100, 6) AS win_rate_pct, round(ad, 6) AS avg_trade_duration,
  coalesce((SELECT max(len) FROM {p}_isl i WHERE i.symbol = a.symbol AND i.strategy = a.strategy AND win), 0) AS max_consec_wins,
  coalesce((SELECT max(len) FROM {p}_isl i WHERE i.symbol = a.symbol AND i.strategy = a.strategy AND NOT win), 0) AS max_consec_losses,
  round(aw * wr - al * (1 - wr), 6) AS expectancy, round(pay, 6) AS payoff_ratio, round(aw, 6) AS avg_win_pct, round(al, 6) AS avg_loss_pct,
  round(CASE WHEN mdd <> 0 AND round(mdd, 2) <> 0 THEN abs(round(tot, 2)) / abs(round(mdd, 2)) ELSE 0 END, 6) AS recovery_factor,
  round(CASE WHEN pay > 0 THEN greatest(0, 0.5 * (wr - (1 - wr) / pay)) ELSE 0 END, 6) AS kelly_fraction,
  CAST(coalesce(d.len, 0) AS INTEGER) AS max_dd_duration
FROM {p}_ratio a LEFT JOIN {p}_ddl d ON d.symbol = a.symbol AND d.strategy = a.strategy
"""

metrics_ctes("ma")


@query("metrics_ma", METRICS_SQL.format(p="ma"))
def metrics_ma(spark, sf):
    return shown(K.metrics(K.equity_curve(G.compute_signals(T.bars(spark, sf), ["MA Crossover"])), rounded=False))


add_book("all", "sigs")
metrics_ctes("all")


@query("metrics_all", METRICS_SQL.format(p="all"))
def metrics_all(spark, sf):
    return shown(K.metrics(K.equity_curve(G.compute_signals(T.bars(spark, sf))), rounded=False))


@query("trades_all", TRADE_SQL.format(p="all", fee=0.0))
def trades_all(spark, sf):
    return K.round_trips(K.equity_curve(G.compute_signals(T.bars(spark, sf))))


FEE, RISK = 0.001, 0.1
cte(
    "sig_vol",
    f"""
SELECT symbol, 'Turtle' AS strategy, dt, close, signal, {rl('avg', 'tr', 14)} AS atr
FROM (SELECT *, greatest(high - low, abs(high - rpc), abs(low - rpc)) AS tr
      FROM (SELECT x.*, s.signal, lag(x.close) OVER (PARTITION BY x.symbol ORDER BY x.dt) AS rpc FROM b x JOIN sig_tu s ON s.symbol = x.symbol AND s.dt = x.dt
            WHERE x.n >= 60 AND x.dt >= DATE '1996-01-01' AND x.dt <= DATE '2000-12-31'))
""",
)
add_book("vol", "sig_vol", FEE, f"CASE WHEN atr > 0 THEN least(1.0::DOUBLE, {RISK} / (atr * 2 / close)) ELSE {RISK} END")
add_book("fix", "sig_vol", FEE, f"{RISK}::DOUBLE")
metrics_ctes("vol")
metrics_ctes("fix")


def ranged_turtle(spark, sf, mode):
    return backtest(
        T.bars(spark, sf), ["Turtle"], "1996-01-01", "2000-12-31", commission=FEE, mode=mode, risk=RISK
    )


@query("metrics_volatility_sizing", METRICS_SQL.format(p="vol"))
def metrics_volatility_sizing(spark, sf):
    return shown(K.metrics(ranged_turtle(spark, sf, "volatility").curve, rounded=False))


@query("metrics_fixed_sizing", METRICS_SQL.format(p="fix"))
def metrics_fixed_sizing(spark, sf):
    return shown(K.metrics(ranged_turtle(spark, sf, "fixed_frac").curve, rounded=False))


@query("trades_volatility_sizing", TRADE_SQL.format(p="vol", fee=FEE))
def trades_volatility_sizing(spark, sf):
    return ranged_turtle(spark, sf, "volatility").trades


@query(
    "compare_strategies",
    """
SELECT symbol, strategy, round(tot - bhr, 2) AS alpha_pct,
  CAST(row_number() OVER (PARTITION BY symbol ORDER BY round(tot - bhr, 2) DESC, strategy) AS INTEGER) AS alpha_rank
FROM all_agg
""",
)
def compare_strategies(spark, sf):
    m = K.metrics(K.equity_curve(G.compute_signals(T.bars(spark, sf))))
    return K.ranked_strategies(m).select("symbol", "strategy", "alpha_pct", "alpha_rank")


@query(
    "equity_drawdown",
    "SELECT symbol, strategy, dt, round(pk, 4) AS peak, round((eq - pk) / pk, 6) AS drawdown FROM all_day",
)
def equity_drawdown(spark, sf):
    c = K.equity_curve(G.compute_signals(T.bars(spark, sf)))
    return shown(add_drawdown(c, by=K.KEY), "symbol", "strategy", "dt", "peak", "drawdown", peak=4)


@query(
    "equity_rolling_sharpe",
    f"""
SELECT symbol, strategy, dt, round({rl('avg', 'r', 63, 'symbol, strategy')} / nullif({rl('stddev_samp', 'r', 63, 'symbol, strategy')}, 0) * sqrt(252), 4) AS rolling_sharpe
FROM all_day
""",
)
def equity_rolling_sharpe(spark, sf):
    c = K.equity_curve(G.compute_signals(T.bars(spark, sf)))
    return shown(add_rolling_sharpe(c, by=K.KEY), "symbol", "strategy", "dt", "rolling_sharpe", digits=4)


@query(
    "equity_monthly",
    f"""
SELECT symbol, CAST(year(m) AS INTEGER) AS year,
{", ".join(f"round(sum(CASE WHEN month(m) = {k} THEN r END), 4) AS m{k:02d}" for k in range(1, 13))}
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM
  (SELECT symbol, m, (e / lag(e) OVER (PARTITION BY symbol ORDER BY m) - 1) * 100 AS r FROM
    (SELECT symbol, last_day(dt) AS m, arg_max(eq, dt) AS e FROM ma_eq GROUP BY 1, 2)) WHERE r IS NOT NULL)
WHERE k >= 3 GROUP BY 1, 2
""",
)
def equity_monthly(spark, sf):
    c = K.equity_curve(G.compute_signals(T.bars(spark, sf), ["MA Crossover"]))
    return shown(B.monthly_pivot(c), digits=4)


@query(
    "pnl_histogram",
    """
SELECT strategy, floor(pnl / 2.5) * 2.5 AS bin_low, count(*) AS n FROM all_eq WHERE pnl IS NOT NULL GROUP BY 1, 2
""",
)
def pnl_histogram(spark, sf):
    t = K.round_trips(K.equity_curve(G.compute_signals(T.bars(spark, sf))))
    return K.histogram(t, "pnl_pct", 2.5, ["strategy"])


cte(
    "rs_path",
    """
SELECT symbol, sim, o, 10000 * product(1 + pnl / 100) OVER (PARTITION BY symbol, sim ORDER BY o ROWS UNBOUNDED PRECEDING) AS v
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, sim ORDER BY k) AS o FROM
  (SELECT symbol, sim, pnl, md5('7:' || sim || ':' || t) AS k
   FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS nt FROM all_eq WHERE strategy = 'Turtle' AND pnl IS NOT NULL)
   CROSS JOIN (SELECT unnest(range(1000)) AS sim) WHERE nt >= 3))
""",
)
cte(
    "rs_end",
    """
SELECT symbol, sim, arg_max(v, o) AS v, min((v - pk) / pk) * 100 AS dd
FROM (SELECT *, max(v) OVER (PARTITION BY symbol, sim ORDER BY o ROWS UNBOUNDED PRECEDING) AS pk FROM rs_path) GROUP BY 1, 2
""",
)


@query(
    "trade_resampling",
    """
SELECT symbol, round((quantile_cont(v, 0.5) / 10000 - 1) * 100, 2) AS median_return, round((quantile_cont(v, 0.05) / 10000 - 1) * 100, 2) AS p5_return,
       round((quantile_cont(v, 0.95) / 10000 - 1) * 100, 2) AS p95_return, round(quantile_cont(dd, 0.5), 2) AS median_max_dd,
       round(quantile_cont(dd, 0.05), 2) AS p95_max_dd
FROM rs_end GROUP BY 1
""",
)
def trade_resampling(spark, sf):
    t = K.round_trips(K.equity_curve(G.compute_signals(T.bars(spark, sf), ["Turtle"])))
    return K.resample_summary(K.resample_paths(t)).drop("strategy")
