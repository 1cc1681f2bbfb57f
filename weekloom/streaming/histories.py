"""Features of each key's weeks from an unbounded table of transactions.

The state of a key is bounded: sums of the weeks that are still open, and its last quantities. A week closes when the
watermark, which follows the ends of the weeks seen, passes its end: then its row comes out, with the features that its key's
weeks before give it, and it joins the history. A timer at the end of the first open week closes it where no more rows come.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.panel import KEYS
from weekloom.params import Params
from weekloom.sources.stages import reachable

_STATE = "weeks array<long>, sums array<double>, history array<double>"
_WEEK_MS = 7 * 86_400_000


def _features(history: list[float], lags: tuple[int, ...]) -> list[float]:
    """Lags, mean and deviation of four weeks and share of eight that sold, as operators.features.basic_features has them."""
    four, eight = history[-4:], history[-8:]
    rolled = [float(np.mean(four)), float(np.std(four, ddof=1))] if len(four) == 4 else [0.0, 0.0]
    return [*(history[-k] if len(history) >= k else 0.0 for k in lags), *rolled, sum(x > 0 for x in eight) / 8 if len(eight) == 8 else 0.0]


def _closing(first_ms: int, lags: tuple[int, ...], keep: int, names: list[str]):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        weeks, sums, history = map(list, state.get) if state.exists else ([], [], [])
        total = dict(zip(weeks, sums))
        for frame in frames:
            for week, quantity in frame.groupby("week_of_year")["quantity"].sum().items():
                total[int(week)] = total.get(int(week), 0.0) + float(quantity)
        passed, out = state.getCurrentWatermarkMs(), []
        for week in sorted(total):
            if first_ms + week * _WEEK_MS > passed:
                break
            quantity = max(total.pop(week), 0.0)
            out.append((*key, week, quantity, *_features(history, lags)))
            history = [*history, quantity][-keep:]
        state.update((sorted(total), [total[w] for w in sorted(total)], history))
        if total:
            state.setTimeoutTimestamp(max(passed + 1, first_ms + min(total) * _WEEK_MS))
        yield pd.DataFrame(out, columns=names)

    return run


def weekly_features(transactions: DataFrame, first: datetime.date, delay: str = "7 days", params: Params = Params()) -> DataFrame:
    """(key, week_of_year, qty, lags, rmean_4, rstd_4, nonzero_frac_8) of each closed week of a stream of transactions
    (transaction_date, pdv, internal_product_id, quantity).

    first is the date that begins week 1. A week closes when a row of a week that ends more than delay later has come, so that
    with seven days its rows may come until the week after the next begins; rows that come after that are left out, whatever
    their key. Null quantities are 0; rows without date or key, and those before first, are left out.
    """
    reachable(transactions.sparkSession)
    week = (F.floor(F.datediff(F.col("transaction_date").cast("date"), F.lit(first)) / 7) + 1).cast("long")
    rows = transactions.select(*(F.col(k).cast("long").alias(k) for k in KEYS), F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"), week.alias("week_of_year"))
    rows = rows.dropna().filter(F.col("week_of_year") > 0)
    first_ms = int(datetime.datetime(first.year, first.month, first.day, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    rows = rows.withColumn("week_end", F.timestamp_millis(F.lit(first_ms) + F.col("week_of_year") * _WEEK_MS)).withWatermark("week_end", delay)
    names = [*KEYS, "week_of_year", "qty", *(f"lag_{k}" for k in params.basic_lags), "rmean_4", "rstd_4", "nonzero_frac_8"]
    schema = ", ".join(f"{n} {'long' if n in (*KEYS, 'week_of_year') else 'double'}" for n in names)
    keep = max(params.history_kept, *params.basic_lags, 8)
    return rows.groupBy(*KEYS).applyInPandasWithState(_closing(first_ms, params.basic_lags, keep, names), schema, _STATE, "append", "EventTimeTimeout")
