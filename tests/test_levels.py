"""Streams of session levels and zones, with shuffled bars and a restart, against the bars in order."""

import datetime as dt
import random

import pytest

from tapeline.streaming import levels as lv

T0 = dt.datetime(2024, 3, 8)  # New York changes its clocks two days later


def bars(n, seed):
    rng, out, p = random.Random(seed), [], 100.0
    for i in range(n):
        p += rng.gauss(0, 1)
        out.append((T0 + dt.timedelta(hours=i), p + rng.random(), p - rng.random(), p))
    return out


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Rows of a stream over shuffled files, stopped and started again half-way."""
    data = {"a": bars(150, 1), "b": bars(120, 2)}
    rows = [(s, *b, "clash") for s, bs in data.items() for b in bs]
    rng = random.Random(3)
    rows.sort(key=lambda r: (r[1] + dt.timedelta(hours=rng.random() * 5), r[0]))  # up to five hours out of order
    rows += [("a", T0 + dt.timedelta(days=90), 1.0, 1.0, 1.0, "clash"), ("a", T0 + dt.timedelta(days=95), 1.0, 1.0, 1.0, "clash")]
    kind = "symbol string, bar_ts timestamp, high double, low double, close double, session string"

    def run(make, name):
        where = tmp_path_factory.mktemp(name)
        cuts = [0, 60, 61, 130, 200, len(rows) - 1, len(rows)]
        for half in (cuts[:4], cuts[3:]):
            for a, b in zip(half, half[1:]):
                spark.createDataFrame(rows[a:b], kind).coalesce(1).write.mode("append").parquet(f"{where}/in")
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
            q = make(stream).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/c").trigger(availableNow=True).start()
            assert q.awaitTermination(300)
        return [tuple(r) for r in spark.read.parquet(f"{where}/out").collect() if r.bar_ts < T0 + dt.timedelta(days=80)]

    return data, run


def test_session_levels(streamed):
    data, run = streamed
    got = {r[:2]: r[2:] for r in run(lambda s: lv.session_level_stream(s, late="6 hours"), "levels")}
    for symbol, rows in data.items():
        seen, runs = [], []
        for ts, high, low, _ in rows:
            local = ts.replace(tzinfo=dt.UTC).astimezone(lv.NEW_YORK)
            code = 1 if local.hour >= 19 or local.hour < 3 else 2 if local.hour < 8 else 3 if local.hour < 16 else 0
            if not runs or runs[-1][0] != code:
                runs.append((code, []))
            runs[-1][1].append((high, low))
            want = [code]
            for c in (1, 2, 3):
                past = [r for k, r in runs[:-1] if k == c]
                want += [max(h for h, _ in past[-1]), min(x for _, x in past[-1])] if past else [None, None]
            day = [(h, x) for d, h, x in seen if d == local.date() - dt.timedelta(days=1)]
            want += [max(h for h, _ in day), min(x for _, x in day)] if day else [None, None]
            seen.append((local.date(), high, low))
            assert got[symbol, ts] == pytest.approx(tuple(want))
    assert len(got) == 270


def test_zones(streamed):
    data, run = streamed
    got = run(lambda s: lv.zone_stream(s, age=12, late="6 hours"), "zones")
    for symbol, rows in data.items():
        want, zones = [], []
        for i, (ts, high, low, _) in enumerate(rows):
            for z in list(zones):
                n, kind, top, bottom = z[:4]
                if i - n > 12:
                    want.append((ts, "expired", kind, rows[n][0], z[4]))
                    zones.remove(z)
                elif low <= top if kind == "bullish" else high >= bottom:
                    z[4] = min((top - max(low, bottom) if kind == "bullish" else min(high, top) - bottom) / (top - bottom), 1.0)
                    over = low <= bottom if kind == "bullish" else high >= top
                    want.append((ts, "filled" if over else "filling", kind, rows[n][0], z[4]))
                    if over:
                        zones.remove(z)
            if i >= 2:
                high2, low2, mid = rows[i - 2][1], rows[i - 2][2], rows[i - 1][3]
                if low > high2 and (low - high2) / mid >= 0.001 or high < low2 and (low2 - high) / mid >= 0.001:
                    zones.append([i, "bullish", low, high2, 0.0] if low > high2 else [i, "bearish", low2, high, 0.0])
                    want.append((ts, "formed", zones[-1][1], ts, 0.0))
        mine = sorted((r[1], r[2], r[3], r[4], round(r[7], 9)) for r in got if r[0] == symbol)
        assert mine == sorted((*w[:4], round(w[4], 9)) for w in want)
        assert {"formed", "filling", "filled", "expired"} == {w[1] for w in want}
    assert all(r[8] == (r[2] == "filling" and 0.3 <= r[7] <= 0.7) for r in got)
