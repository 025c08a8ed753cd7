"""Structured Streaming: running counters and running bills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BILLS = "stream string, account string, ms long, late long"
STATE = "account string, since long, late long"


def running_counters(ticks: DataFrame) -> DataFrame:
    """Counters kept up to date tick by tick (update or complete mode): late rows always count."""
    return ticks.groupBy("kind", "name").agg(F.when(F.col("kind") == "max", F.max("n")).otherwise(F.sum("n")).alias("value"))


def _bill(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    account, since, late = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values(["ms", "account"], na_position="first")  # one stream's rows of one micro-batch
    out: dict[str, int] = {}
    dropped = 0
    for at, name, reset in zip(rows["ms"], rows["account"], rows["reset"]):
        if reset:
            account, since = None, None
            continue
        if since is not None and at < since:
            dropped += 1
            continue
        if account is not None and since is not None:
            out[account] = out.get(account, 0) + int(at - since)
        account, since = (None if pd.isna(name) else name), int(at)
    late += dropped
    state.update((account, since, late))
    yield pd.DataFrame([(key[0], a, n, dropped) for a, n in out.items()] or [(key[0], None, 0, dropped)], columns=["stream", "account", "ms", "late"])


def running_bills(switches: DataFrame) -> DataFrame:
    """Time billed in each micro-batch, from switches(stream, ms, account, reset): each switch bills the time since the one before it to the account open then; a null account
    stops billing, a reset forgets the open account. Rows older than the open start are counted as late and bill nothing. Sum ms by account."""
    return switches.groupBy("stream").applyInPandasWithState(_bill, BILLS, STATE, "append", "NoTimeout")
