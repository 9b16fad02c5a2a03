"""Market-series analytics on Spark: bars, signals, fills, trades, equity and risk."""

from barlattice.session import get_session

__all__ = ["get_session"]
