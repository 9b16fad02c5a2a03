"""Registry of runnable queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlattice.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def r(expr: str, digits: int, name: str | None = None) -> str:
    """SQL rounding to ``digits`` that never yields negative zero."""
    out = f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
    return f"{out} AS {name}" if name else out


# The derived tables of barlattice.sources.tables, as SQL.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (
        SELECT event_type AS symbol, '1h' AS timeframe, date_trunc('hour', ts) AS ts,
               arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, row(ts, event_id)) AS close,
               CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS volume,
               avg(value) AS average,
               event_type || '_' || CAST((day(min(ts)) - 1) // 7 AS VARCHAR) AS contract
        FROM events GROUP BY event_type, date_trunc('hour', ts)) b"""),
    "bars5": ((), """
      SELECT event_type AS symbol, '5m' AS timeframe,
             time_bucket(INTERVAL '5 minutes', ts) AS ts,
             arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
             arg_max(value, row(ts, event_id)) AS close,
             CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS volume
      FROM events GROUP BY event_type, time_bucket(INTERVAL '5 minutes', ts)"""),
    "specs": ((), """
      SELECT * FROM (VALUES ('click', 0.01::DOUBLE, 1::DOUBLE), ('error', 0.01, 5), ('purchase', 0.01, 20),
                            ('signup', 0.01, 50)) AS t(symbol, tick_size, multiplier)"""),
    "fills": ((), """
      SELECT '0' AS run_id, CAST(user_id % 3 AS INTEGER) AS slot_id, event_type AS symbol, ts,
             event_id AS fill_id, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
             CAST(1 + CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS DOUBLE) AS quantity,
             value AS fill_price,
             2.5::DOUBLE * (1 + CAST(json_extract(props, '$.k') AS BIGINT) % 3) AS commission,
             0.01::DOUBLE AS slippage
      FROM events"""),
    "trades": ((), """
      SELECT '0' AS run_id, l_returnflag AS strategy, CAST(l_suppkey AS VARCHAR) AS symbol,
             CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS direction,
             least(o_orderdate, l_shipdate) AS entry_time,
             greatest(o_orderdate, l_shipdate) AS exit_time, l_quantity AS quantity,
             l_extendedprice * (0.05::DOUBLE - l_discount) AS pnl,
             l_extendedprice * l_tax * 0.01::DOUBLE AS commission,
             l_extendedprice * 0.0005::DOUBLE AS slippage, o_orderpriority AS exit_reason
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "itrades": (("bars",), """
      SELECT a.symbol || '-' || CAST(a.rn AS VARCHAR) AS trade_id, '0' AS run_id,
             CAST(a.rn % 3 AS INTEGER) AS slot_id, a.symbol,
             CASE WHEN a.rn % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
             a.ts AS entry_time, z.ts AS exit_time, a.open AS entry_price, z.close AS exit_price,
             1.0::DOUBLE AS quantity,
             CASE WHEN a.rn % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END * (z.close - a.open) AS pnl,
             0.5::DOUBLE AS commission, 0.25::DOUBLE AS slippage,
             CASE a.rn % 3 WHEN 0 THEN 'TAKE_PROFIT' WHEN 1 THEN 'STOP_LOSS' ELSE 'TIME_STOP' END
               AS exit_reason,
             CASE a.rn % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS strategy
      FROM bars a JOIN bars z ON a.symbol = z.symbol AND z.rn = a.rn + 1 + a.rn % 6"""),
    "slot_hist": ((), """
      SELECT '0' AS run_id, slot_id, ts,
             sum(step) OVER (PARTITION BY slot_id ORDER BY ts) AS cum_pnl
      FROM (SELECT s.slot_id, h.ts, coalesce(e.step, 0) AS step
            FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events) h
            CROSS JOIN (VALUES (0), (1), (2)) AS s(slot_id)
            LEFT JOIN (SELECT CAST(user_id % 3 AS INTEGER) AS slot_id, date_trunc('hour', ts) AS ts,
                              sum(value) - count(*) * any_value(m) AS step
                       FROM events JOIN (SELECT user_id % 3 AS k, avg(value) AS m FROM events
                                         GROUP BY 1) ON k = user_id % 3
                       GROUP BY 1, 2) e ON e.slot_id = s.slot_id AND e.ts = h.ts)"""),
    "hist": (("slot_hist",), """
      SELECT run_id, ts, 100000::DOUBLE + sum(cum_pnl) AS total_value
      FROM slot_hist GROUP BY run_id, ts"""),
    "hourly": (("slot_hist", "hist"), """
      SELECT 'slot_' || CAST(slot_id AS VARCHAR) AS stream, ts, 100000::DOUBLE + cum_pnl AS equity
      FROM slot_hist UNION ALL SELECT 'portfolio', ts, total_value FROM hist"""),
    "dayslot": ((), """
      SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS slot_id,
             CAST(o_orderdate AS DATE) AS day,
             sum(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN -1.0
                 ELSE 0.1 END) / 1009.0::DOUBLE AS pnl
      FROM orders GROUP BY 1, 2"""),
    "dayeq": (("dayslot",), """
      SELECT 'slot_' || CAST(slot_id AS VARCHAR) AS stream, slot_id, CAST(day AS TIMESTAMP) AS ts, day,
             1000000::DOUBLE + sum(pnl) OVER (PARTITION BY slot_id ORDER BY day) AS equity
      FROM dayslot"""),
    "trials": ((), """
      SELECT CAST(1 + l_orderkey % 5 AS INTEGER) AS fold_id, l_partkey AS trial_id,
             avg(l_discount * 40 - 1) / 1.0093::DOUBLE AS sharpe, avg(l_tax * 50 - 1) / 1.0107::DOUBLE AS sortino,
             count(*) AS trades, -max(l_quantity) * 0.5::DOUBLE AS max_drawdown,
             avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate,
             avg(l_extendedprice) AS avg_win, -avg(l_extendedprice * 0.9::DOUBLE) AS avg_loss,
             l_partkey % 7 + 5 AS fast, (l_partkey % 11) * 0.25::DOUBLE + 0.5 AS mult,
             CASE l_partkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'long' ELSE 'short' END AS side
      FROM lineitem GROUP BY l_orderkey % 5, l_partkey"""),
    "expo": (("fills",), """
      SELECT run_id, slot_id, symbol, date_trunc('hour', ts) AS ts,
             sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END * quantity) AS qty,
             sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END * quantity * fill_price) AS notional
      FROM fills GROUP BY 1, 2, 3, 4"""),
}


def ema_cte(src: str, x: str, span: float, keep: float | None = None) -> str:
    """SQL of the exponential mean written out as its weighted sum (table: symbol, rn, y)."""
    a = repr(keep if keep is not None else 1.0 - 2.0 / (span + 1.0))
    return f"""
      SELECT t.symbol, t.rn,
             sum(CASE WHEN i.rn = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {a}::DOUBLE END
                 * pow({a}::DOUBLE, t.rn - i.rn) * i.{x}) AS y
      FROM {src} t JOIN {src} i ON i.symbol = t.symbol AND i.rn <= t.rn
      GROUP BY t.symbol, t.rn"""


TRUE_RANGE = """
      SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr
      FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM bars) q"""
CTES["tr"] = (("bars",), TRUE_RANGE)
for _span in (14, 20):
    CTES[f"atr{_span}"] = (("tr",), ema_cte("tr", "tr", _span))
for _span in (3, 20, 50, 200):
    CTES[f"ema{_span}"] = (("bars",), ema_cte("bars", "close", _span))


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` under WITH, with the named derived tables and the ``extra`` ones before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def phi(z: str) -> str:
    """SQL normal distribution function by its power series (|z| up to 8)."""
    c = f"least(greatest({z}, -8::DOUBLE), 8::DOUBLE)"
    term = ("exp((2 * k + 1) * ln(greatest(abs({c}), 1e-300::DOUBLE)) - lgamma(k + 1.5::DOUBLE)"
            " - (k + 1) * ln(2) + 0.5 * ln(pi()))").format(c=c)
    series = f"list_sum(list_transform(range(0, 160), lambda k: {term}))"
    return f"(0.5 + sign({c}) * exp(-{c} * {c} / 2) / sqrt(2 * pi()) * {series})"


def t_tails(t: str, v: str) -> str:
    """SQL two-sided Student-t probability by Simpson's rule on the density."""
    w = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = (f"list_sum(list_transform(range(0, 2001), lambda i: ({w}) * pow(1 + pow(abs({t}) * i / 2000.0::DOUBLE, 2) / ({v}), "
            f"-(({v}) + 1) / 2.0::DOUBLE))) * abs({t}) / 6000.0::DOUBLE")
    scale = f"exp(lgamma((({v}) + 1) / 2.0::DOUBLE) - lgamma(({v}) / 2.0::DOUBLE)) / sqrt(({v}) * pi())"
    return f"greatest(0, 1 - 2 * {area} * {scale})"
