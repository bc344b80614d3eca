"""Retracement signals and cooled rows against plain loops."""

import math
import random

import pytest

from tapeline.operators.ordering import cooled
from tapeline.operators.retracements import retracement_signals

from .test_zones import COLUMNS, walk


@pytest.mark.parametrize("block", [4096, 7, 3])
def test_cooled(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("aab"), rng.randrange(1, 300), 1) for _ in range(260)] + [("c", 5, 1), ("c", 5, 2), ("c", 8, 1), ("c", 9, 1)]
    got = {k: [] for k in "abc"}
    for r in cooled(spark.createDataFrame(rows, "key string, no int, v int"), ["key"], 4, block=block).collect():
        got[r.key].append(r.no)
    for key in "abc":
        last, want = -99, []
        for no in sorted({n for k, n, _ in rows if k == key}):
            if no - last >= 4:
                last = no
                want += [no] * sum(r[:2] == (key, no) for r in rows)
        assert sorted(got[key]) == want


def loop_signals(rows, back=20, tolerance=0.002, least=0.02, confidence=0.48):
    bars, out, last = [dict(zip(COLUMNS[1:], r, strict=True)) for r in rows], [], -9
    for i in range(back + 5, len(bars)):
        b = bars[i]
        if i - last < 4 or not (b["atr"] or 0) > 0:
            continue
        past = bars[i - back : i]
        highs, lows = [x["high"] for x in past], [x["low"] for x in past]
        top, low = max(highs), min(lows)
        up = lows.index(low) - highs.index(top)
        if not up or (top - low) / ((top + low) / 2) < least:
            continue
        up = up > 0
        deep = top - 0.618 * (top - low) if up else low + 0.618 * (top - low)
        body = abs(b["close"] - b["open"])
        if up:
            good = b["low"] < deep * (1 - tolerance) and b["close"] > deep and (b["close"] > b["open"] or body > 0 and min(b["open"], b["close"]) - b["low"] > body * 0.5)
        else:
            good = b["high"] > deep * (1 + tolerance) and b["close"] < deep and (b["close"] < b["open"] or body > 0 and b["high"] - max(b["open"], b["close"]) > body * 0.5)
        if not good:
            continue
        mean = sum(x["volume"] for x in bars[i - 19 : i + 1]) / 20
        score = min((deep - b["low"] if up else b["high"] - deep) / b["atr"] / 0.5, 1) * 0.3 + 0.2 * (b["ema_50"] > b["ema_200"] if up else b["ema_50"] < b["ema_200"])
        score += 0.15 * (30 <= b["rsi"] <= 50 if up else 50 <= b["rsi"] <= 70) + 0.15 * (b["volume"] > 1.2 * mean) + 0.2 * (b["structure"] > 0 if up else b["structure"] < 0)
        stop = low - 0.3 * b["atr"] if up else top + 0.3 * b["atr"]
        if score >= confidence and (b["close"] > stop) == up:
            out.append((i + 1, "LONG" if up else "SHORT", b["close"], stop, score))
            last = i
    return out


@pytest.mark.parametrize("options", [{}, {"confidence": 0.2, "back": 9}, {"confidence": 0.1, "tolerance": 0.0, "least": 0.005}])
def test_signals(spark, options):
    data = {"a": walk(2500, 5), "b": walk(900, 6, 0.5), "tiny": walk(4, 7)}
    kind = "key string, no int, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, atr double, rsi double, ema_50 double, ema_200 double, structure double, rv_rank double"
    df = spark.createDataFrame([(k, *r) for k, rs in data.items() for r in rs], kind).repartition(4)
    got = {k: [] for k in data}
    for r in retracement_signals(df, by=["key"], **options).orderBy("key", "no").collect():
        got[r.key].append((r.no, r.direction, r.entry, r.sl, r.confidence))
        assert r.risk == pytest.approx(abs(r.entry - r.sl)) and not math.isnan(r.tp1)
    for key, rows in data.items():
        want = loop_signals(rows, **options)
        assert [g[:2] for g in got[key]] == [w[:2] for w in want] and all(g[2:] == pytest.approx(w[2:]) for g, w in zip(got[key], want, strict=True))
    assert len(got["a"]) > 10 or options == {}
    assert retracement_signals(df.limit(0), by=["key"]).collect() == []
