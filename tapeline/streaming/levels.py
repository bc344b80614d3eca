"""Session levels and zones of imbalance as state of a stream of bars.

Bars may arrive in any order within the watermark: they wait in list state, a timer at each bar's own time releases them in order, and what a series needs to know from then on
is a few levels or the zones that are still open.  Needs the RocksDB state store; a query that starts again from its checkpoint goes on where it was.

Defined results: of bars with the same time the one that came last counts (first wins once it is released); bars later than the watermark are dropped by Spark; a bar without a
high or low changes nothing and gives no row; levels that no session or day has set yet are null."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_BAR = "bar_ts timestamp, high double, low double, close double"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEW_YORK = ZoneInfo("America/New_York")
#: Sessions by hours of New York: code, first hour, hour after the last. Fixed values.
SESSIONS = {1: ("asia", 19, 3), 2: ("london", 3, 8), 3: ("new_york", 8, 16)}
LEVEL_COLUMNS = [f"{name}_{side}" for name, _, _ in SESSIONS.values() for side in ("high", "low")]
LEVELS = "symbol string, bar_ts timestamp, session int, " + ", ".join(f"{c} double" for c in LEVEL_COLUMNS) + ", prev_day_high double, prev_day_low double"
ZONES = "symbol string, bar_ts timestamp, event string, kind string, formed_ts timestamp, top double, bottom double, fill_share double, in_entry_zone boolean"


def session_code(ts: dt.datetime) -> int:
    """0: no session; ts is in UTC."""
    hour = ts.replace(tzinfo=dt.UTC).astimezone(NEW_YORK).hour
    return next((code for code, (_, a, b) in SESSIONS.items() if (a <= hour < b if a < b else hour >= a or hour < b)), 0)


def follow_sessions(state: dict, ts: dt.datetime, high: float, low: float) -> list[tuple]:
    """One bar: the levels of sessions that are over, and of the day before."""
    code, day = session_code(ts), ts.replace(tzinfo=dt.UTC).astimezone(NEW_YORK).date()
    last, days = state.setdefault("last", {}), state.setdefault("days", {})
    if state.get("code") not in (None, code):
        if state["code"] and state.get("now"):
            last[str(state["code"])] = state["now"]
        state["now"] = None
    wider = lambda old: [max(high, old[0]), min(low, old[1])] if old else [high, low]
    if code:
        state["now"] = wider(state.get("now"))
    state["code"], days[str(day)] = code, wider(days.get(str(day)))
    before = str(day - dt.timedelta(days=1))
    state["days"] = {k: v for k, v in days.items() if k in (before, str(day))}
    levels = [x for c in SESSIONS for x in last.get(str(c), (None, None))]
    return [(code, *levels, *days.get(before, (None, None)))]


def follow_zones(state: dict, ts: dt.datetime, high: float, low: float, close: float, least: float, age: int) -> list[tuple]:
    """One bar: what happens to open zones (event, kind, formed, top, bottom, fill share, whether an entry may lie there), then the zone that it forms."""
    out, kept = [], []
    state["n"] = state.get("n", 0) + 1
    for zone in state.get("zones", ()):
        kind, formed, top, bottom, no, fill = zone
        if state["n"] - no > age:
            out.append(("expired", kind, formed, top, bottom, fill, False))
            continue
        touched = low <= top if kind == "bullish" else high >= bottom
        if touched:
            fill = min((top - max(low, bottom) if kind == "bullish" else min(high, top) - bottom) / (top - bottom), 1.0)
            filled = low <= bottom if kind == "bullish" else high >= top
            out.append(("filled" if filled else "filling", kind, formed, top, bottom, fill, not filled and 0.3 <= fill <= 0.7))
            if filled:
                continue
        kept.append([kind, formed, top, bottom, no, fill])
    bars = state.get("bars", [])
    if len(bars) == 2:
        (high2, low2, _), (_, _, mid) = bars
        if mid > 0 and (low > high2 and (low - high2) / mid >= least or high < low2 and (low2 - high) / mid >= least):
            zone = ["bullish", ts.isoformat(), low, high2] if low > high2 else ["bearish", ts.isoformat(), low2, high]
            kept.append([*zone, state["n"], 0.0])
            out.append(("formed", *zone, 0.0, False))
    state["zones"], state["bars"] = kept, [*bars, [high, low, close]][-2:]
    return out


class _InOrder(StatefulProcessor):
    """Holds bars until their time has come; `follow` sees them in order."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BAR)
        self.known = handle.getValueState("known", "state string")

    def follow(self, state: dict, ts: dt.datetime, high: float, low: float, close: float) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts, high, low, close in pdf[["bar_ts", "high", "low", "close"]].itertuples(index=False):
                if pd.isna(ts) or pd.isna(high) or pd.isna(low):
                    continue
                self.waiting.appendValue((ts.to_pydatetime(), float(high), float(low), float("nan") if pd.isna(close) else float(close)))
                self.handle.registerTimer(_ms(ts.to_pydatetime()))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, now, later = expiredTimerInfo.getExpiryTimeInMs(), {}, []
        for bar in self.waiting.get():
            if _ms(bar[0]) <= until:
                now[bar[0]] = bar
            else:
                later.append(bar)
        if now:
            state = json.loads(self.known.get()[0]) if self.known.exists() else {}
            done = state.get("done", "")
            out = []
            for ts in sorted(now):
                if ts.isoformat() > done:
                    out += [(key[0], ts, *row) for row in self.follow(state, *now[ts])]
                    state["done"] = ts.isoformat()
            self.known.update((json.dumps(state),))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if out:
                yield pd.DataFrame(out, columns=self.columns)
                return
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def _ms(ts: dt.datetime) -> int:
    return int(ts.replace(tzinfo=dt.UTC).timestamp() * 1000)


class SessionLevels(_InOrder):
    columns = [c.split()[0] for c in LEVELS.split(", ")]

    def follow(self, state, ts, high, low, close):
        return follow_sessions(state, ts, high, low)


class OpenZones(_InOrder):
    columns = [c.split()[0] for c in ZONES.split(", ")]

    def __init__(self, least: float, age: int):
        self.least, self.age = least, age

    def follow(self, state, ts, high, low, close):
        rows = follow_zones(state, ts, high, low, close, self.least, self.age)
        return [(e, kind, dt.datetime.fromisoformat(formed), *rest) for e, kind, formed, *rest in rows]


def _stream(bars: DataFrame, processor: StatefulProcessor, kind: str, late: str) -> DataFrame:
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    bars = bars.select("symbol", "bar_ts", "high", "low", "close").withWatermark("bar_ts", late)
    return bars.groupBy("symbol").transformWithStateInPandas(processor, outputStructType=kind, outputMode="Append", timeMode="EventTime")


def session_level_stream(bars: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Per bar (symbol, bar_ts, high, low, close; times in UTC) its session and the high and low of the last whole sessions and of the day before in New York."""
    return _stream(bars, SessionLevels(), LEVELS, late)


def zone_stream(bars: DataFrame, *, least: float = 0.001, age: int = 50, late: str = "1 hour") -> DataFrame:
    """What happens to zones of imbalance: formed, filling (with the share that the bar fills), filled, or expired after `age` bars."""
    return _stream(bars, OpenZones(least, age), ZONES, late)
