"""Candles every second, for the data source's test."""


def fetch(symbol, timeframe, start, end, page):
    return [(t, 1.0, 2.0, 0.5, 1.5, 10.0) for t in range((start + 999) // 1000 * 1000, end, 1000)][:page]
