"""The tables of ``workload/tables.py`` and shared building blocks as SQL for the checking engine."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _uses(body: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", body)]


def with_ctes(body: str) -> str:
    """Put every named block the query mentions, directly or not, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _uses(CTES[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for n in _uses(body):
        visit(n)
    if not order:
        return body.strip()
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" if not CTES[n].startswith("--rec") else f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {blocks}\n{body.strip()}"


cte(
    "bar_days",
    """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS dt,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS BIGINT) AS s,
       greatest(max(CAST(round(l_discount * 100) AS BIGINT) - 5), 0) AS up,
       greatest(-min(CAST(round(l_discount * 100) AS BIGINT) - 5), 0) AS down,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2
""",
)
cte(
    "bar_walk",
    """
SELECT *, CAST(sum(s) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM bar_days
""",
)
cte(
    "bar_levels",
    """
SELECT *, abs((((c + 900) % 1200) + 1200) % 1200 - 600) AS c1,
       abs((((c - s + 900) % 1200) + 1200) % 1200 - 600) AS c0
FROM bar_walk
""",
)
cte(
    "bars",
    """
SELECT symbol, dt,
       round(exp((c0 - 300) * 0.004::DOUBLE) * 10000, 0) AS open,
       round(exp((greatest(c0, c1) + up - 300) * 0.004::DOUBLE) * 10000, 0) AS high,
       round(exp((least(c0, c1) - down - 300) * 0.004::DOUBLE) * 10000, 0) AS low,
       round(exp((c1 - 300) * 0.004::DOUBLE) * 10000, 0) AS close,
       volume
FROM bar_levels
""",
)
cte(
    "b",
    """
SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
       lag(close) OVER w AS pc
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)
""",
)
cte(
    "vix_days",
    """
SELECT CAST(o_orderdate AS DATE) AS dt, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS s,
       count(*)::DOUBLE AS k
FROM orders GROUP BY 1
""",
)
cte(
    "vix",
    """
SELECT dt, round(s / k / 1000000, 2) AS vix,
       round(sum(s) OVER w / sum(k) OVER w / 1000000, 2) AS vix_3m
FROM vix_days WINDOW w AS (ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)
""",
)
cte(
    "spots",
    "SELECT symbol, max(dt) AS asof_dt, arg_max(close, dt) AS spot FROM bars GROUP BY symbol",
)
cte(
    "contracts",
    """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS opt_side,
       l_orderkey % 2 AS far, l_partkey % 21 AS k,
       sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE AS d,
       CAST(sum(l_quantity) AS BIGINT) AS open_interest, count(*) AS volume
FROM lineitem GROUP BY 1, 2, 3, 4
""",
)
cte(
    "chain",
    """
SELECT symbol, asof_dt, asof_dt + CASE WHEN far = 0 THEN 12 ELSE 47 END AS expiry, opt_side,
       round(spot * (k + 40)::DOUBLE / 50, 2) AS strike,
       CASE WHEN k = 5 THEN 0.03::DOUBLE
            ELSE round(0.08::DOUBLE + d / volume / 50 + greatest(0, 10 - k)::DOUBLE / 50, 10) END AS implied_vol,
       open_interest, volume
FROM contracts JOIN spots USING (symbol)
""",
)
cte(
    "meta",
    """
SELECT symbol, asof_dt, spot, symbol AS ticker, spot AS futures_spot, false AS proxy_used FROM spots WHERE CAST(symbol AS BIGINT) % 2 = 0
UNION ALL SELECT symbol, asof_dt, spot, symbol || '=F', spot * 2, true FROM spots WHERE CAST(symbol AS BIGINT) % 2 = 1 OR CAST(symbol AS BIGINT) % 4 = 0
""",
)
