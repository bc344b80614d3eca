"""Segments of a share are composed as they are drawn: what is shuffled does not grow with a key's trades, and shares change no path."""

import random

import pytest

from tapeline.operators import resampling as r


def test_shares_are_rows(spark):
    rng = random.Random(1)
    rows = [("s", i, round(rng.gauss(0, 1), 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "strategy string, entry_time long, r_multiple double")
    options = {"rounds": 20, "size": 5, "seed": 7, "steps": 30, "least": 5}
    shares = r._shares(df, "strategy", "entry_time", tasks=4, **options).collect()
    assert [x.share for x in sorted(shares, key=lambda x: x.share)] == [0, 1, 2, 3]  # of 30 segments
    one, many = ({x.path: x for x in r.resampled_paths(df, tasks=t, **options).collect()} for t in (1, 7))
    fan = {x.trade: x for x in r.equity_fan(df, tasks=7, bands=(0, 100), **options).collect()}
    assert one.keys() == many.keys() == set(range(20)) and fan.keys() == set(range(1, 901))
    for k in one:
        assert tuple(many[k])[1:] == pytest.approx(tuple(one[k])[1:], abs=1e-9)
    ends = [x.final_r for x in one.values()]
    assert (fan[900].p0, fan[900].p100) == pytest.approx((min(ends), max(ends)))
