"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = (
    "symbol STRING, timeframe STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, "
    "close DOUBLE, volume DOUBLE, average DOUBLE, contract STRING"
)
FILLS = (
    "run_id STRING, slot_id INT, symbol STRING, ts TIMESTAMP_NTZ, fill_id BIGINT, side STRING, "
    "quantity DOUBLE, fill_price DOUBLE, commission DOUBLE, slippage DOUBLE, exit_reason STRING"
)
TRADES = (
    "run_id STRING, slot_id INT, strategy STRING, symbol STRING, direction STRING, "
    "entry_time TIMESTAMP_NTZ, exit_time TIMESTAMP_NTZ, entry_price DOUBLE, exit_price DOUBLE, "
    "quantity DOUBLE, pnl DOUBLE, commission DOUBLE, slippage DOUBLE, gross_pnl DOUBLE, "
    "exit_reason STRING, entry_signal_time TIMESTAMP_NTZ"
)
HISTORY = (
    "run_id STRING, ts TIMESTAMP_NTZ, cash DOUBLE, holdings DOUBLE, margin_used DOUBLE, "
    "gross_notional DOUBLE, total_value DOUBLE"
)
SLOT_HISTORY = "run_id STRING, slot_id INT, ts TIMESTAMP_NTZ, cum_pnl DOUBLE"
EXPOSURE = (
    "run_id STRING, slot_id INT, symbol STRING, ts TIMESTAMP_NTZ, qty DOUBLE, notional DOUBLE"
)
BENCHMARK = "run_id STRING, ts TIMESTAMP_NTZ, close DOUBLE"
DAILY_SLOT_PNL = "run_id STRING, slot_id INT, day DATE, pnl DOUBLE"
INSTRUMENT_CLOSES = "run_id STRING, symbol STRING, day DATE, close DOUBLE"
METRICS = "run_id STRING, metrics_json STRING"

OHLC = ("open", "high", "low", "close")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail on the driver when a needed column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def require_no_null_prices(bars: DataFrame) -> DataFrame:
    """Raise inside the job when an OHLC price is null or NaN (recurrences need dense input)."""
    bad = F.lit(False)
    for c in OHLC:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    checked = F.when(bad, F.raise_error(F.lit("null price in bars")).cast("double"))
    return bars.withColumn("close", F.coalesce(checked, F.col("close")))
