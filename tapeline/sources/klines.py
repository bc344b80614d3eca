"""A Python data source for exchange candles: pages by last open time, one partition per symbol and time slice.

`provider` names the function that returns the candles of a slice, as `module:function` (imported where the source is planned and read) or a name
registered in PROVIDERS of that process; the network ones are left to the user."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, str, int, int, int], list[tuple]]
PROVIDERS: dict[str, Fetch] = {}


def provider(name: str) -> Fetch:
    if name in PROVIDERS:
        return PROVIDERS[name]
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Slice(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class KlineReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        start, end, size = int(self.options["start"]), int(self.options["end"]), int(self.options.get("slice", 86_400_000 * 30))
        return [Slice(s, a, min(a + size, end)) for s in self.options["symbols"].split(",") for a in range(start, end, size)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        import datetime as dt

        at, seen, page = partition.start, set(), int(self.options.get("page", 1000))
        timeframe = self.options.get("timeframe", "15m")
        while at < partition.end:
            rows = self.fetch(partition.symbol, timeframe, at, partition.end, page)
            for ms, *values in rows:
                if ms not in seen and ms < partition.end:
                    seen.add(ms)
                    yield (partition.symbol, timeframe, dt.datetime.fromtimestamp(ms / 1000, dt.UTC).replace(tzinfo=None), *map(float, values))
            if len(rows) < page:
                return
            at = rows[-1][0] + 1


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, timeframe string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options, provider(self.options["provider"]))
