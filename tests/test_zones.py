"""First passages and zone signals against plain loops over bars."""

import datetime as dt
import math
import random

import pytest

from tapeline.operators import zones as z

T0 = dt.datetime(2024, 1, 1)
COLUMNS = ["key", "no", "bar_ts", "open", "high", "low", "close", "volume", "atr", "rsi", "ema_50", "ema_200", "structure", "rv_rank"]


def walk(n, seed, step=1.0):
    rng, out, p = random.Random(seed), [], 100.0
    for i in range(n):
        o, c = p + rng.gauss(0, step / 2), p + rng.gauss(0, step)
        h, low = max(o, c) + rng.random() * step / 3, min(o, c) - rng.random() * step / 3
        ts = T0 + dt.timedelta(hours=i)
        rank = [None, float("nan"), rng.random(), rng.random()][rng.randrange(4)]
        out.append((i + 1, ts, o, h, low, c, rng.random() * 10, [None, 1.0, 2.0, float("nan")][rng.randrange(1, 3) if rng.random() < 0.9 else 3 * rng.randrange(2)], rng.random() * 100,
            p + rng.gauss(0, 1), p, rng.choice([-1.0, 0.0, 1.0]), rank))
        p = c
    return out


def loop_signals(rows, dvol=None, least=0.002, age=50, confidence=0.45):
    """The zones of one series followed bar by bar."""
    bars = [dict(zip(COLUMNS[1:], r, strict=True)) for r in rows]
    active, flipped, used, last, out = [], [], set(), -9, []
    for i, b in enumerate(bars):
        if i >= 2:
            two, mid = bars[i - 2], bars[i - 1]
            past = [x["volume"] for x in bars[max(0, i - 20) : i]]
            busy = len(past) >= 10 and mid["volume"] > 1.2 * sum(past) / len(past)
            for bull, top, bottom in ((True, b["low"], two["high"]), (False, two["low"], b["high"])):
                if top > bottom and (top - bottom) / mid["close"] >= least:
                    active.append((i, bull, top, bottom, (top - bottom) / mid["close"], busy))
        active = [v for v in active if i - v[0] <= age]
        flipped = [v for v in flipped if i - v[0] <= age]
        for v in list(active):
            if b["close"] < v[3] if v[1] else b["close"] > v[2]:
                active.remove(v)
                flipped.append((i, not v[1], *v[2:]))
        if i - last < 4 or not (b["atr"] or 0) > 0 or not 7 <= b["bar_ts"].hour < 21:
            continue
        ref = bars[i - 5]["close"] if i >= 5 else 0
        move = abs((b["close"] - ref) / ref) if ref > 0 else 0.0
        swept = [True, True]
        if i >= 25:
            old, new = bars[i - 25 : i - 5], bars[i - 5 : i + 1]
            swept = [min(x["low"] for x in new) < min(x["low"] for x in old), max(x["high"] for x in new) > max(x["high"] for x in old)]
        rank = b["rv_rank"] if b["rv_rank"] is not None and not math.isnan(b["rv_rank"]) else None
        for kind, some in ((0, active), (1, flipped)):
            best = None
            for since, up, top, bottom, share, busy in some:
                if i - since < 2 or (kind, since) in used or not (b["low"] <= top and b["high"] >= bottom) or kind and rank is not None and rank < 0.5:
                    continue
                score = min(share / 0.005, 1) * 0.20 + 0.15 * busy + 0.15 * (b["ema_50"] > b["ema_200"] if up else b["ema_50"] < b["ema_200"])
                score += 0.10 * (30 <= b["rsi"] <= 55 if up else 45 <= b["rsi"] <= 70) + 0.10 * (b["structure"] > 0 if up else b["structure"] < 0)
                score += min(move / 0.015, 1) * 0.15 + 0.15 * swept[0 if up else 1] + 0.10 * bool(kind and rank is not None)
                if score >= confidence and (best is None or score > best[0] + 1e-12):
                    best = (score, since, up, top, bottom)
            if best:
                score, since, up, top, bottom = best
                room = max(0.3 * (top - bottom), 0.3 * b["atr"])
                entry = (top + bottom) / 2
                stop = bottom - room if up else top + room
                out.append((i + 1, "LONG" if up else "SHORT", ["RETEST", "IFVG"][kind], entry, stop, entry + (entry - stop) * (3.0 - kind), score))
                used.add((kind, since))
                last = i
                break
    return out


@pytest.fixture(scope="module")
def data():
    return {"a": walk(700, 1), "b": walk(431, 2, 0.4), "tiny": walk(2, 3)}


@pytest.fixture(scope="module")
def bars(spark, data):
    rows = [(k, *r) for k, rs in data.items() for r in rs]
    kind = "key string, no int, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, atr double, rsi double, ema_50 double, ema_200 double, structure double, rv_rank double"
    return spark.createDataFrame(rows, kind).repartition(4).cache()


@pytest.mark.parametrize("block", [256, 7, 2])
def test_first_passage(spark, bars, data, block):
    rng = random.Random(block)
    asked = [(k, rng.randint(1, len(data[k]) + 3), 100 + rng.gauss(0, 15), rng.random() < 0.5, i) for i in range(400) for k in [rng.choice(["a", "b", "tiny"])]] + [("none", 1, 1.0, True, 999)]
    df = spark.createDataFrame(asked, "key string, start int, level double, below boolean, id int")
    for strict in (True, False):
        got = {r.id: r.hit for r in z.first_passage(df, bars, by=["key"], low="low", high="high", strict=strict, block=block).collect()}
        for k, start, level, below, i in asked:
            beyond = (lambda r: r[4] < level) if below else (lambda r: r[3] > level)
            assert got[i] == next((r[0] for r in data.get(k, [])[start - 1 :] if beyond(r)), None)


def test_zone_lives(bars, data):
    for r in z.zone_lives(bars, by=["key"]).collect():
        rows = data[r.key]
        far = (lambda b: b[5] < r.bottom) if r.bullish else (lambda b: b[5] > r.top)
        near = (lambda b: b[4] <= r.top) if r.bullish else (lambda b: b[3] >= r.bottom)
        later = [b for b in rows if r.formed <= b[0] <= r.formed + 50]
        assert r.broken == next((b[0] for b in later if far(b)), None) and r.touched == next((b[0] for b in later[1:] if near(b)), None)


@pytest.mark.parametrize("options", [{}, {"confidence": 0.2, "age": 20}, {"least": 0.0005, "confidence": 0.3}])
def test_signals(bars, data, options):
    got = {k: [] for k in data}
    for r in z.zone_signals(bars, by=["key"], **options).orderBy("key", "no").collect():
        got[r.key].append((r.no, r.direction, r.signal_type, r.entry, r.sl, r.tp1, r.confidence))
    for key, rows in data.items():
        want = loop_signals(rows, **options)
        assert [g[:3] for g in got[key]] == [w[:3] for w in want]
        assert all(g[3:] == pytest.approx(w[3:], abs=1e-9) for g, w in zip(got[key], want, strict=True))
    assert len(got["a"]) > 15 and {g[2] for g in got["a"]} == {"RETEST", "IFVG"}


def test_optional_columns_and_empty(bars):
    from pyspark.sql import functions as F

    plain = bars.select(*[c for c in bars.columns if c not in ("rsi", "ema_50", "ema_200", "structure", "rv_rank")])
    assert z.zone_signals(plain, by=["key"], confidence=0.2).count() > 0
    assert z.zone_signals(plain.withColumn("calm", F.lit(True)), by=["key"], confidence=0.2).count() == 0
    low, high = (z.touches(plain.withColumn("dvol", F.lit(v)), by=["key"], confidence=0.2) for v in (40.0, 70.0))
    assert low.where("flipped = 0 AND NOT long OR flipped = 1 AND long").count() == 0 and high.where("flipped = 0 AND long").count() == 0 and high.where("flipped = 1 AND long").count() > 0
    assert z.zone_signals(bars.limit(0), by=["key"]).collect() == []
