"""Candles and drawdown state as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import sinks


def ticks_to_bars(ticks: DataFrame, *, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling bars of (symbol, ts, price, size); a bar is emitted once the watermark has passed it."""
    w = F.window("ts", width)
    out = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.lit(width).alias("timeframe"), F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def ingest(bars: DataFrame, path: str, checkpoint: str, *, arrival: str | None = None, trigger: dict | None = None):
    """K5: candles upserted by micro-batch. A candle that is sent again replaces the one before it, within a batch by `arrival` (a column that orders them and is
    not stored; without it rows of one candle in one batch must be alike). A batch that runs twice changes nothing."""

    def write(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            sinks.upsert(df, path, order=arrival, drop=(arrival,) if arrival else ())

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


STATE = "recent array<double>, streak int, equity double, peak double, cooldown int, reason string"
OUT = "strategy string, ts timestamp, r_multiple double, window_dd double, overall_dd double, streak int, paused boolean, reason string"


def drawdown_guard(trades: DataFrame, *, window: int = 20, limit: float = 10.0, losses: int = 7, cooldown: int = 5) -> DataFrame:
    """Live drawdown state per strategy over (strategy, ts, r_multiple). A strategy pauses on the worst drawdown within the last full window, on a streak of losses
    (R below 0) or on a fall of twice the limit from its peak.  The pause is lifted at the `cooldown`-th trade after it, and that trade is tested at once, so a reason
    that still holds renews it; with a cooldown of 0 it stays.  `reason` names what began the pause. State is a few numbers per strategy."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, streak, equity, peak, rest, reason = state.get if state.exists else ([], 0, 0.0, 0.0, 0, "")
        recent, rows = list(recent), []
        pdf = pd.concat(list(batches))  # a key's trades of one micro-batch, which come in several chunks
        if len(pdf):
            for ts, r in pdf.sort_values("ts")[["ts", "r_multiple"]].itertuples(index=False):
                if rest > 0:
                    rest -= 1
                    reason = reason if rest else ""
                recent = [*recent, float(r)][-window:]
                streak = streak + 1 if r < 0 else 0
                equity += float(r)
                peak = max(peak, equity)
                run, top, worst = 0.0, float("-inf"), 0.0
                for x in recent:
                    run += x
                    top = max(top, run)
                    worst = max(worst, top - run)
                if not reason:
                    reason = "window" if len(recent) == window and worst >= limit else "streak" if streak >= losses else "overall" if peak - equity >= 2 * limit else ""
                    rest = cooldown if reason else 0
                rows.append((key[0], ts, float(r), worst, peak - equity, streak, bool(reason), reason))
        state.update((recent, streak, equity, peak, rest, reason))
        yield pd.DataFrame(rows, columns=["strategy", "ts", "r_multiple", "window_dd", "overall_dd", "streak", "paused", "reason"])

    return trades.groupBy("strategy").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
