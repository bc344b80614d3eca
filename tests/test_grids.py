"""Parameter grids against the public listing of the sequence and counts by hand."""

from pyspark.sql import functions as F

from tapeline.operators import grids as g

SPECS = [g.Parameter("gap", 0.002, 0.001, 0.005, 0.001), g.Parameter("age", 50, 20, 80, 20, whole=True), g.Parameter("rate", 0.01, 0.001, 1.0, 0.0, log=True)]
#: The first ten points in three dimensions, as published with the direction numbers.
LISTED = [(0, 0, 0), (0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75), (0.375, 0.375, 0.625), (0.875, 0.875, 0.125), (0.625, 0.125, 0.875), (0.125, 0.625, 0.375),
    (0.1875, 0.3125, 0.9375), (0.6875, 0.8125, 0.4375)]


def test_sobol_points(spark):
    got = spark.range(64).select(*[g.sobol(F.col("id"), d).alias(f"d{d}") for d in range(10)]).collect()
    assert [tuple(r)[:3] for r in got[:10]] == LISTED
    for d in range(10):  # each 64th of the axis holds one of 64 points, with or without a shift
        assert sorted(int(r[d] * 64) for r in got) == list(range(64))
    pairs = {(int(r[0] * 8), int(r[1] * 8)) for r in got}
    assert len(pairs) == 64
    turned = spark.range(64).select(g.sobol(F.col("id"), 4, 0x12345678).alias("x")).collect()
    assert sorted(int(r.x * 64) for r in turned) == list(range(64))


def test_full_grid(spark):
    got = g.full_grid(spark, SPECS).collect()
    assert len(got) == len(set(got)) == 5 * 4 and {r.age for r in got} == {20, 40, 60, 80} and {r.gap for r in got} == {0.001, 0.002, 0.003, 0.004, 0.005} and {r.rate for r in got} == {0.01}
    few = g.full_grid(spark, SPECS, most=7).collect()
    assert len(few) == 6 and {r.gap for r in few} == {0.001, 0.003, 0.005} and {r.age for r in few} == {20, 60}


def test_sobol_grid_and_neighbours(spark):
    got = g.sobol_grid(spark, SPECS, 65).collect()
    assert len(got) == 65 and tuple(got[0]) == (0.002, 50, 0.01) and got == g.sobol_grid(spark, SPECS, 65).collect()
    assert all(0.001 <= r.gap <= 0.005 and abs(r.gap * 1000 - round(r.gap * 1000)) < 1e-9 and r.age in (20, 40, 60, 80) and 0.001 <= r.rate <= 1 for r in got[1:])
    assert 18 <= sum(r.rate < 0.0316 for r in got[1:]) <= 46  # half of the points in half of the log range
    near = g.neighbours(spark.createDataFrame([(0.001, 40, 0.01), (0.002, 40, 0.01)], "gap double, age long, rate double"), SPECS).collect()
    assert sorted(map(tuple, near)) == sorted({(0.002, 40, 0.01), (0.001, 20, 0.01), (0.001, 60, 0.01), (0.001, 40, 0.01), (0.003, 40, 0.01), (0.002, 20, 0.01), (0.002, 60, 0.01)})
    assert g.sobol_grid(spark, [], 9).count() == 1 and g.neighbours(spark.range(0).select(F.lit(1.0).alias("gap")), SPECS[:1]).count() == 0
