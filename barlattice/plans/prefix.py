"""Order-dependent state machines over long series in three passes, however long the series is.

Some recursions (range bars, the Kalman hedge ratio) have no window form. A block of rows is first
reduced to a summary: what it does to any state it may be entered with. The summaries of a series, one
row per block, are then gone through in order, which gives each block the state it starts from, and
the blocks are run once more from there. The blocks are written once; no pass is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.plans.blocks import _BLK, _LO, _OWN, with_halo
from barlattice.plans.lineage import settle


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    summarise: Callable[[pd.DataFrame], dict],
    summary: str,
    begin: Callable[[pd.Series], dict],
    advance: Callable[[dict, pd.Series], dict],
    state: str,
    run: Callable[[pd.DataFrame, dict, bool], pd.DataFrame],
    output: str,
    block_rows: int | None = None,
) -> DataFrame:
    """Run a machine along each series of ``df`` in order of ``ts``.

    ``summarise(rows)`` reduces one block to the fields of ``summary`` (DDL). ``begin(first summary)``
    is the state before a series, ``advance(state, summary)`` the state after a block. ``run(rows,
    state, is_last_block)`` makes the rows of ``output`` (DDL) from a block and the state before it.
    """
    keys = list(keys)
    columns = [*df.columns]
    blocks = settle(with_halo(df, keys, ts, block_rows=block_rows).drop(_OWN, _LO))
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    names = [part.strip().split(" ")[0] for part in state.split(",")]

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, _BLK: int(pdf[_BLK].iloc[0]), **summarise(pdf[columns])}])

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_BLK)
        held, out = begin(pdf.iloc[0]), []
        for i, (_, row) in enumerate(pdf.iterrows()):
            out.append({**{k: row[k] for k in keys}, _BLK: row[_BLK], "_is_last": i == len(pdf) - 1,
                        **{f"_in_{n}": held[n] for n in names}})
            held = advance(held, row)
        return pd.DataFrame(out)

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        first = pdf.iloc[0]
        return run(pdf[columns], {n: first[f"_in_{n}"] for n in names}, bool(first["_is_last"]))

    given = ", ".join(f"_in_{part.strip()}" for part in state.split(","))
    parts = blocks.groupBy(*keys, _BLK).applyInPandas(reduced, f"{key_ddl}, {_BLK} long, {summary}")
    states = parts.groupBy(*keys).applyInPandas(handed, f"{key_ddl}, {_BLK} long, _is_last boolean, {given}")
    return blocks.join(states, [*keys, _BLK]).groupBy(*keys, _BLK).applyInPandas(made, output)
