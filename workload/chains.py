"""Option-chain and range queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import options as O
from barloom.operators import ranges as R
from barloom.sources import logs as SL

from . import tables as T
from .registry import query, shown
from .sql import cte

KEY = "symbol, asof_dt, expiry"
J = "USING (symbol, asof_dt, expiry)"


def quotes(spark, sf):
    return O.with_spot(T.chain(spark, sf), T.chain_meta(spark, sf))


cte("quotes", "SELECT c.*, m.spot FROM chain c JOIN spots m ON m.symbol = c.symbol AND m.asof_dt = c.asof_dt")
cte(
    "gex",
    f"""
SELECT {KEY}, spot, strike, round(coalesce(sum(g) FILTER (opt_side = 'C'), 0), 2) AS call_gex, round(coalesce(-sum(g) FILTER (opt_side = 'P'), 0), 2) AS put_gex,
       round(coalesce(sum(g) FILTER (opt_side = 'C'), 0) - coalesce(sum(g) FILTER (opt_side = 'P'), 0), 2) AS net_gex
FROM (SELECT *, CASE WHEN implied_vol > 0.05 AND open_interest > 0 THEN exp(-d * d / 2) / sqrt(2 * pi()) / (spot * implied_vol * sqrt(y)) * open_interest * 100 * spot END AS g
  FROM (SELECT *, (ln(spot / strike) + (0.045 + implied_vol * implied_vol / 2) * y) / (implied_vol * sqrt(y)) AS d
    FROM (SELECT *, greatest(expiry - asof_dt, 1) / 365 AS y FROM quotes WHERE strike BETWEEN spot * 0.85 AND spot * 1.15)))
GROUP BY {KEY}, spot, strike
""",
)


@query("gex", f"SELECT {KEY}, strike, call_gex, put_gex, net_gex FROM gex")
def gex(spark, sf):
    return O.gex_profile(quotes(spark, sf)).drop("spot")


cte(
    "gex_b",
    f"""
SELECT {KEY}, round(sum(abs(net_gex) * strike) FILTER (side = 'b' AND k <= 5) / nullif(sum(abs(net_gex)) FILTER (side = 'b' AND k <= 5), 0), 2) AS gex_floor,
       round(sum(abs(net_gex) * strike) FILTER (side = 'a' AND k <= 5) / nullif(sum(abs(net_gex)) FILTER (side = 'a' AND k <= 5), 0), 2) AS gex_ceiling
FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, side ORDER BY CASE WHEN side = 'a' THEN net_gex ELSE abs(net_gex) END DESC, strike) AS k
      FROM (SELECT *, CASE WHEN strike > spot THEN 'a' WHEN strike < spot THEN 'b' END AS side FROM gex))
GROUP BY {KEY}
""",
)
cte(
    "gex_s",
    f"""
SELECT {KEY}, sum(net_gex) AS total, (list(strike ORDER BY abs(net_gex) DESC, strike))[1] AS peak FROM gex GROUP BY {KEY}
""",
)


@query("gex_bounds", f"SELECT {KEY}, gex_floor, gex_ceiling FROM gex_b")
def gex_bounds(spark, sf):
    return O.gex_boundaries(O.gex_profile(quotes(spark, sf)))


@query(
    "gex_summary",
    f"SELECT {KEY}, round(total, 2) AS total_gex, CASE WHEN total > 0 THEN 'sticky' ELSE 'slippery' END AS gex_regime, peak AS peak_strike FROM gex_s",
)
def gex_summary(spark, sf):
    return shown(O.gex_summary(O.gex_profile(quotes(spark, sf))), digits=2)


cte(
    "wall_rows",
    f"""
SELECT *, row_number() OVER (PARTITION BY {KEY}, side ORDER BY act DESC, strike) AS k
FROM (SELECT *, CASE WHEN opt_side = 'C' AND strike >= spot THEN 'c' WHEN opt_side = 'P' AND strike <= spot THEN 'p' END AS side,
             CASE WHEN sum(open_interest) OVER (PARTITION BY {KEY}) > 0 THEN open_interest ELSE volume END AS act FROM quotes)
""",
)
cte(
    "walls",
    f"""
SELECT *, round(coalesce(cm, cw), 2) AS cc, round(coalesce(pm, pw), 2) AS pc FROM
(SELECT {KEY}, coalesce(max(strike) FILTER (side = 'c' AND k = 1 AND act > 0), any_value(spot) * 1.05) AS cw,
  coalesce(max(strike) FILTER (side = 'p' AND k = 1 AND act > 0), any_value(spot) * 0.95) AS pw,
  sum(act * strike) FILTER (side = 'c' AND k <= 10) / sum(act) FILTER (side = 'c' AND k <= 10) AS cm,
  sum(act * strike) FILTER (side = 'p' AND k <= 10) / sum(act) FILTER (side = 'p' AND k <= 10) AS pm,
  coalesce(string_agg(CAST(strike AS DECIMAL(12, 2)) || ':' || act, ',' ORDER BY strike) FILTER (side = 'c' AND k <= 10 AND act > 0), '') AS cl,
  coalesce(string_agg(CAST(strike AS DECIMAL(12, 2)) || ':' || act, ',' ORDER BY strike) FILTER (side = 'p' AND k <= 10 AND act > 0), '') AS pl
FROM wall_rows GROUP BY {KEY})
""",
)


@query(
    "oi_walls",
    f"""
SELECT {KEY}, round(cw, 4) AS strongest_call_wall, round(pw, 4) AS strongest_put_wall, cc AS call_cluster, pc AS put_cluster,
       cl AS call_walls, pl AS put_walls, 'open_interest' AS activity_source FROM walls
""",
)
def oi_walls(spark, sf):
    text = lambda c: F.array_join(
        F.transform(c, lambda w: F.concat_ws(":", w["strike"].cast("decimal(12,2)"), w["activity"])), ","
    )
    out = O.oi_walls(quotes(spark, sf))
    out = out.withColumns({"call_walls": text("call_walls"), "put_walls": text("put_walls")})
    return shown(out, digits=4)


cte(
    "pain",
    f"""
SELECT a.symbol, a.asof_dt, a.expiry, a.strike,
       sum(CASE WHEN q.opt_side = 'C' THEN greatest(0, a.strike - q.strike) ELSE greatest(0, q.strike - a.strike) END * q.open_interest) AS pain
FROM (SELECT DISTINCT {KEY}, strike FROM quotes WHERE strike BETWEEN spot * 0.85 AND spot * 1.15 AND open_interest > 0) a
JOIN quotes q ON q.symbol = a.symbol AND q.asof_dt = a.asof_dt AND q.expiry = a.expiry
  AND q.strike BETWEEN q.spot * 0.85 AND q.spot * 1.15 AND q.open_interest > 0
GROUP BY 1, 2, 3, 4
""",
)
cte(
    "pain_min",
    f"""
SELECT s.symbol, s.asof_dt, s.expiry, coalesce(p.mp, s.spot) AS max_pain
FROM (SELECT {KEY}, any_value(spot) AS spot FROM quotes GROUP BY {KEY}) s
LEFT JOIN (SELECT {KEY}, (list(strike ORDER BY round(pain, 6), strike))[1] AS mp FROM pain GROUP BY {KEY}) p {J}
""",
)


@query("max_pain", f"SELECT {KEY}, max_pain FROM pain_min")
def max_pain(spark, sf):
    return O.max_pain(quotes(spark, sf))


cte(
    "moves",
    f"""
SELECT *, spot * iv * sqrt(dte / 365) AS m, spot * iv * sqrt(1 / 365) AS d
FROM (SELECT {KEY}, spot, coalesce(avg(implied_vol) FILTER (k <= 3 AND implied_vol > 0.05), 0.2)::DOUBLE AS iv, any_value(greatest(expiry - asof_dt, 1)) AS dte
      FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, opt_side ORDER BY abs(strike - spot), strike) AS k FROM quotes) GROUP BY {KEY}, spot)
""",
)


@query(
    "expected_move",
    f"""
SELECT {KEY}, round(iv, 4) AS iv_used, 'options' AS iv_source, CAST(dte AS INTEGER) AS days_to_expiry, round(m, 2) AS move_1sigma, round(2 * m, 2) AS move_2sigma,
       round(spot - m, 2) AS low_1sigma, round(spot + m, 2) AS high_1sigma, round(spot - 2 * m, 2) AS low_2sigma, round(spot + 2 * m, 2) AS high_2sigma,
       round(d, 2) AS daily_move, round(spot - d, 2) AS daily_low, round(spot + d, 2) AS daily_high
FROM moves
""",
)
def expected_move(spark, sf):
    return O.expected_move(quotes(spark, sf), T.vix(spark, sf))


def bias_case(x: str) -> str:
    return f"CASE WHEN {x} < 0.7 THEN 'bullish' WHEN {x} > 1.0 THEN 'bearish' ELSE 'neutral' END"


cte(
    "pcr",
    f"""
SELECT *, CASE WHEN co > 0 THEN po / co ELSE 1 END AS ro, CASE WHEN cv > 0 THEN pv / cv ELSE 1 END AS rv
FROM (SELECT {KEY}, CAST(coalesce(sum(open_interest) FILTER (opt_side = 'C'), 0) AS BIGINT) AS co, CAST(coalesce(sum(open_interest) FILTER (opt_side = 'P'), 0) AS BIGINT) AS po,
             CAST(coalesce(sum(volume) FILTER (opt_side = 'C'), 0) AS BIGINT) AS cv, CAST(coalesce(sum(volume) FILTER (opt_side = 'P'), 0) AS BIGINT) AS pv FROM quotes GROUP BY {KEY})
""",
)


@query(
    "put_call",
    f"""
SELECT {KEY}, co AS call_oi, po AS put_oi, cv AS call_volume, pv AS put_volume, round(ro, 3) AS pc_ratio_oi, round(rv, 3) AS pc_ratio_volume,
       CASE WHEN co + po > 100 THEN {bias_case('ro')} ELSE {bias_case('rv')} END AS oi_bias, {bias_case('rv')} AS volume_bias
FROM pcr
""",
)
def put_call(spark, sf):
    return O.put_call_ratios(quotes(spark, sf))


cte(
    "skews",
    f"""
SELECT *, CASE WHEN c > 0 THEN p / c ELSE 1 END AS s FROM
(SELECT {KEY}, coalesce(avg(implied_vol) FILTER (opt_side = 'P' AND strike < spot * 0.97), 0.2)::DOUBLE AS p,
        coalesce(avg(implied_vol) FILTER (opt_side = 'C' AND strike > spot * 1.03), 0.2)::DOUBLE AS c FROM quotes GROUP BY {KEY})
""",
)


@query(
    "iv_skew",
    f"""
SELECT {KEY}, round(s, 3) AS skew_ratio, CASE WHEN s > 1.15 THEN 'bearish' WHEN s < 0.9 THEN 'bullish' ELSE 'neutral' END AS skew_bias,
       round(p, 4) AS otm_put_iv, round(c, 4) AS otm_call_iv FROM skews
""",
)
def iv_skew(spark, sf):
    return O.iv_skew(quotes(spark, sf))


cte(
    "vols",
    """
SELECT symbol, sqrt(avg(hl) FILTER (i >= n - 20) / (4 * ln(2)) * 252) AS p20, sqrt(avg(hl) FILTER (i >= n - 63) / (4 * ln(2)) * 252) AS p63,
       stddev_samp(lr) FILTER (i > n - 63) * sqrt(252) AS cc
FROM (SELECT *, ln(high / low) * ln(high / low) AS hl, ln(close / pc) AS lr FROM b) GROUP BY 1
""",
)
cte(
    "vrp",
    f"""
SELECT {KEY}, iv4, p63, cc, round(greatest(0.7, least(1.0, p63 / iv4)), 4)::DOUBLE AS factor, round((1 - p63 / iv4) * 100, 1) AS pct
FROM (SELECT {KEY}, round(iv, 4) AS iv4 FROM moves) JOIN vols USING (symbol)
""",
)


@query(
    "vrp",
    f"""
SELECT {KEY}, iv4 AS iv_used, round(p63, 4) AS parkinson_long, round(cc, 4) AS close_to_close, factor AS vrp_factor, pct AS vrp_pct, 'parkinson' AS vrp_source FROM vrp
""",
)
def vrp(spark, sf):
    moves = O.expected_move(quotes(spark, sf)).select(*O.CHAIN, "iv_used")
    rows = moves.join(O.recent_volatility(T.bars(spark, sf)), "symbol").withColumns(O.vrp_columns(F.col("iv_used")))
    return shown(rows.drop("parkinson_short"), digits=4)


cte(
    "terms",
    "SELECT *, CASE WHEN vix / vix_3m < 0.95 THEN 'contango' WHEN vix / vix_3m > 1.05 THEN 'backwardation' ELSE 'flat' END AS structure FROM vix",
)


@query("term_structure", "SELECT dt, vix, vix_3m, structure FROM terms")
def term_structure(spark, sf):
    v = T.vix(spark, sf)
    return v.withColumn("structure", O.term_structure(F.col("vix"), F.col("vix_3m")))


cte(
    "usable",
    """
SELECT symbol, asof_dt, coalesce(min(expiry) FILTER (k <= 10 AND (oi >= 1000 OR v >= 1000)), min(expiry)) AS expiry
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, asof_dt ORDER BY expiry) AS k
      FROM (SELECT symbol, asof_dt, expiry, sum(open_interest) AS oi, sum(volume) AS v FROM chain GROUP BY 1, 2, 3)) GROUP BY 1, 2
""",
)


@query("usable_expiry", f"SELECT {KEY} FROM usable")
def usable_expiry(spark, sf):
    return O.usable_expiry(T.chain(spark, sf))


@query(
    "usable_expiry_strict",
    """
SELECT symbol, asof_dt, coalesce(min(expiry) FILTER (oi >= 7600 OR v >= 7600), min(expiry)) AS expiry
FROM (SELECT symbol, asof_dt, expiry, sum(open_interest) AS oi, sum(volume) AS v FROM chain GROUP BY 1, 2, 3) GROUP BY 1, 2
""",
)
def usable_expiry_strict(spark, sf):
    return O.usable_expiry(T.chain(spark, sf), 7600)


@query(
    "nearest_expiries",
    """
SELECT symbol, asof_dt, expiry, CAST(row_number() OVER (PARTITION BY symbol, asof_dt ORDER BY expiry) AS INTEGER) AS expiry_rank
FROM (SELECT DISTINCT symbol, asof_dt, expiry FROM chain)
""",
)
def nearest_expiries(spark, sf):
    return O.nearest_expiries(T.chain(spark, sf))


cte(
    "comp0",
    f"""
SELECT u.*, m.spot, round(v.iv, 4) AS iv4, round(v.d, 2) AS dm, w.cw, w.pw, w.cc, w.pc, p.max_pain, c.ro, c.co, c.po, c.rv,
       k.s, g.gex_floor, g.gex_ceiling, t.total, coalesce(f.fd, 1.5) AS fd, sup.price AS sup, res.price AS res, vo.p20, r.factor, x.structure, x.vix
FROM usable u JOIN spots m USING (symbol, asof_dt) JOIN moves v {J} JOIN walls w {J} JOIN pain_min p {J} JOIN pcr c {J} JOIN skews k {J} LEFT JOIN gex_b g {J}
LEFT JOIN gex_s t {J} LEFT JOIN fdv f ON f.symbol = u.symbol AND f.dt = u.asof_dt
LEFT JOIN levels sup ON sup.symbol = u.symbol AND sup.side = 'support' AND sup.k = 1
LEFT JOIN levels res ON res.symbol = u.symbol AND res.side = 'resistance' AND res.k = 1
JOIN vols vo ON vo.symbol = u.symbol JOIN vrp r ON r.symbol = u.symbol AND r.expiry = u.expiry
ASOF LEFT JOIN terms x ON x.dt <= u.asof_dt
""",
)
cte(
    "comp1",
    """
SELECT *, CASE WHEN fd < 1.35 THEN 'trending' WHEN fd > 1.65 THEN 'choppy' ELSE 'transitional' END AS regime,
  CASE WHEN gex_floor < spot THEN gex_floor * 0.6 + pc * 0.4 ELSE pc END AS dfl, CASE WHEN gex_ceiling > spot THEN gex_ceiling * 0.6 + cc * 0.4 ELSE cc END AS dce
FROM comp0
""",
)
cte(
    "comp2",
    """
SELECT *, dm * factor * ((CASE regime WHEN 'trending' THEN 1.2 WHEN 'choppy' THEN 0.85 ELSE 1 END)::DOUBLE
  * (CASE structure WHEN 'contango' THEN 0.95 WHEN 'backwardation' THEN 1.1 ELSE 1 END)::DOUBLE) AS mv FROM comp1
""",
)
cte(
    "ranges3",
    """
SELECT c.*, level, sigma::DOUBLE AS sigma, prob::DOUBLE AS prob,
  round(CASE WHEN dfl > spot - mv * sigma AND dfl < spot THEN (spot - mv * sigma) * 0.7 + dfl * 0.3 ELSE spot - mv * sigma END + 1e-9, 2) AS lo,
  round(CASE WHEN dce < spot + mv * sigma AND dce > spot THEN (spot + mv * sigma) * 0.7 + dce * 0.3 ELSE spot + mv * sigma END + 1e-9, 2) AS hi
FROM comp2 c CROSS JOIN (VALUES ('1sigma', 1.0::DOUBLE, 68.3), ('1_5sigma', 1.5::DOUBLE, 86.6), ('2sigma', 2.0::DOUBLE, 95.4)) s(level, sigma, prob)
""",
)
cte(
    "evidence",
    f"""
SELECT {KEY}, 'options_walls' AS name, 0.25 AS w, 0::DOUBLE AS value, CASE WHEN spot < (pw + cw) / 2 THEN 'bullish' ELSE 'bearish' END AS bias FROM comp2
UNION ALL SELECT {KEY}, 'gex_levels', 0.20, total, CASE WHEN total > 0 THEN 'bullish' ELSE 'bearish' END FROM comp2
UNION ALL SELECT {KEY}, 'iv_range', 0.20, iv4, 'neutral' FROM comp2
UNION ALL SELECT {KEY}, 'fractals', 0.15, round(fd, 4), CASE WHEN spot - coalesce(sup, spot * 0.95) < coalesce(res, spot * 1.05) - spot THEN 'bullish' ELSE 'bearish' END FROM comp2
UNION ALL SELECT {KEY}, 'put_call_ratio', 0.10, round(ro, 3), CASE WHEN co + po > 100 THEN {bias_case('ro')} ELSE {bias_case('rv')} END FROM comp2
UNION ALL SELECT {KEY}, 'iv_skew', 0.05, round(s, 3), CASE WHEN s > 1.15 THEN 'bearish' WHEN s < 0.9 THEN 'bullish' ELSE 'neutral' END FROM comp2
UNION ALL SELECT {KEY}, 'max_pain', 0.05, max_pain, CASE WHEN spot < max_pain THEN 'bullish' ELSE 'bearish' END FROM comp2
""",
)
cte(
    "bias7",
    f"""
SELECT {KEY}, CASE WHEN u > d AND u > r THEN 'BULLISH' WHEN d > u AND d > r THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias,
       round(greatest(u, d, r)::DOUBLE / (u + d + r)::DOUBLE * 100, 1) AS confidence
FROM (SELECT {KEY}, coalesce(sum(w) FILTER (bias = 'bullish'), 0) AS u, coalesce(sum(w) FILTER (bias = 'bearish'), 0) AS d, coalesce(sum(w) FILTER (bias = 'neutral'), 0) AS r
      FROM evidence GROUP BY {KEY})
""",
)


def inputs(spark, sf):
    return R.composite_inputs(T.chain(spark, sf), T.chain_meta(spark, sf), T.bars(spark, sf), T.vix(spark, sf))


@query("evidence", f"SELECT {KEY}, name, round(value, 4) AS value, bias FROM evidence")
def evidence(spark, sf):
    return shown(R.evidence_rows(inputs(spark, sf)), digits=4)


@query("bias_vote", f"SELECT {KEY}, bias, confidence FROM bias7")
def bias_vote(spark, sf):
    return R.bias_vote(R.evidence_rows(inputs(spark, sf)))


@query("floor_ceiling", f"SELECT {KEY}, level, sigma, prob AS probability, lo AS floor, hi AS ceiling FROM ranges3")
def floor_ceiling(spark, sf):
    return R.range_rows(R.add_range(inputs(spark, sf)))


cte(
    "comp_rows",
    f"""
SELECT m.ticker, {KEY}, round(CASE WHEN proxy_used THEN futures_spot ELSE spot END, 2) AS spot_price, round(spot, 2) AS proxy_spot, proxy_used, round(futures_spot / spot, 4) AS price_ratio,
  round(max(lo * futures_spot / spot) FILTER (level = '1sigma'), 2) AS floor_1sigma, round(max(hi * futures_spot / spot) FILTER (level = '1sigma'), 2) AS ceiling_1sigma,
  round(max(lo * futures_spot / spot) FILTER (level = '1_5sigma'), 2) AS floor_1_5sigma, round(max(hi * futures_spot / spot) FILTER (level = '1_5sigma'), 2) AS ceiling_1_5sigma,
  round(max(lo * futures_spot / spot) FILTER (level = '2sigma'), 2) AS floor_2sigma, round(max(hi * futures_spot / spot) FILTER (level = '2sigma'), 2) AS ceiling_2sigma,
  bias, confidence, iv4 AS iv_used, factor AS vrp_factor, regime, structure, vix,
  CASE WHEN vix IS NULL THEN 'unknown' WHEN vix < 15 THEN 'low_vol' WHEN vix < 25 THEN 'normal' WHEN vix < 35 THEN 'elevated' ELSE 'crisis' END AS vix_regime,
  max_pain, round(fd, 3) AS fractal_dimension, round(p20, 4) AS parkinson_rv, sup AS support, res AS resistance,
  round(pw, 4) AS strongest_put_wall, round(cw, 4) AS strongest_call_wall, round(ro, 3) AS pc_ratio_oi, round(s, 3) AS skew_ratio,
  gex_floor, gex_ceiling, round(total, 2) AS total_gex
FROM ranges3 JOIN bias7 {J} JOIN (SELECT symbol, asof_dt, ticker, futures_spot, proxy_used FROM meta) m USING (symbol, asof_dt) GROUP BY ALL
""",
)


def analysis(spark, sf):
    out = R.composite_analysis(T.chain(spark, sf), T.chain_meta(spark, sf), T.bars(spark, sf), T.vix(spark, sf))
    return out.withColumns({"total_gex": F.round("total_gex", 2)} | {c: F.round(c, 4) for c in ("strongest_put_wall", "strongest_call_wall")})


@query("composite", "SELECT * FROM comp_rows")
def composite(spark, sf):
    return analysis(spark, sf)


@query(
    "prediction_log",
    """
SELECT asof_dt AS date, CAST(asof_dt AS TIMESTAMP) + INTERVAL 16 HOUR AS timestamp, ticker, spot_price, floor_1sigma AS floor, ceiling_1sigma AS ceiling,
       bias, confidence, expiry, round(vix, 2) AS vix, total_gex AS gex_net, vix_regime AS regime FROM comp_rows
""",
)
def prediction_log(spark, sf):
    at = F.timestamp_add("HOUR", F.lit(16), F.col("asof_dt").cast("timestamp_ntz"))
    return SL.prediction_rows(analysis(spark, sf), F.col("asof_dt"), at)


@query(
    "price_structure_days",
    """
SELECT symbol, dt, round(coalesce(fd, 1.5), 6) AS fd, last_value(pl IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING) AS support,
       last_value(ph IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING) AS resistance,
       round(CASE WHEN i >= 19 THEN sqrt(avg(hl) OVER (w ROWS 19 PRECEDING) / (4 * ln(2)) * 252) END, 6) AS parkinson_short,
       round(CASE WHEN i >= 62 THEN sqrt(avg(hl) OVER (w ROWS 62 PRECEDING) / (4 * ln(2)) * 252) END, 6) AS parkinson_long,
       round(CASE WHEN i >= 62 THEN stddev_samp(lr) OVER (w ROWS 61 PRECEDING) * sqrt(252) END, 6) AS close_to_close
FROM (SELECT b.*, ln(high / low) * ln(high / low) AS hl, ln(close / pc) AS lr, p.pl, p.ph, f.fd
      FROM b LEFT JOIN (SELECT symbol, dt, pl, ph FROM piv) p USING (symbol, dt) LEFT JOIN fdv f USING (symbol, dt))
WINDOW w AS (PARTITION BY symbol ORDER BY dt)
""",
)
def price_structure_days(spark, sf):
    return shown(R.add_price_structure(T.bars(spark, sf)), "symbol", "dt", *R.STRUCTURE)
