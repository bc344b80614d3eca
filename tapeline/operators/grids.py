"""Parameter grids as DataFrames: full, quasi-random, and neighbours of given points. Rows are made from their numbers alone, so a grid of any size is spread."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Primitive polynomials (degree, inner coefficients) and first direction numbers of the Sobol sequence for dimensions 2 to 10 (Joe and Kuo). Fixed values.
DIRECTIONS = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)))
BITS = 32


@dataclass(frozen=True)
class Parameter:
    name: str
    default: float
    least: float
    most: float
    step: float = 0.0
    whole: bool = False
    log: bool = False

    def steps(self) -> int:
        """Number of values on the axis."""
        return 1 if self.step <= 0 else sum(self.least + i * self.step <= self.most + 1e-9 for i in range(int(round((self.most - self.least) / self.step)) + 1)) or 1


def direction_numbers(dimension: int) -> list[int]:
    """The dimension's direction numbers (from 0), as fractions of 2^32."""
    if dimension == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    degree, inner, first = DIRECTIONS[dimension - 1]
    v = [m << (BITS - 1 - i) for i, m in enumerate(first)]
    for i in range(degree, BITS):
        new = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if inner >> (degree - 1 - k) & 1:
                new ^= v[i - k]
        v.append(new)
    return v


def sobol(number: Column, dimension: int, shift: int = 0) -> Column:
    """The dimension's coordinate of the number-th point (from 0), in Gray-code order; shift: bits that all points are turned by (a random digital shift)."""
    gray = number.bitwiseXOR(F.shiftright(number, 1))
    bits = [F.when(F.shiftright(gray, i).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")) for i, v in enumerate(direction_numbers(dimension))]
    return reduce(Column.bitwiseXOR, bits, F.lit(shift).cast("long")) / float(1 << BITS)


def _set(p: Parameter, value: Column) -> Column:
    """On the axis and within its ends, to six digits or whole."""
    if p.step > 0:
        value = F.bround(value / p.step, 0) * p.step
    value = F.greatest(F.lit(float(p.least)), F.least(value, F.lit(float(p.most))))
    return F.bround(value, 0).cast("long").alias(p.name) if p.whole else F.round(value, 6).alias(p.name)


def full_grid(spark: SparkSession, parameters: list[Parameter], *, most: int = 1000) -> DataFrame:
    """All combinations; while there are more than `most` the step of the longest axis doubles (ten times at most, then points are drawn instead)."""
    specs = list(parameters)
    for _ in range(10):
        sizes = [p.steps() for p in specs]
        if math.prod(sizes) <= most:
            break
        k = sizes.index(max(sizes))
        specs[k] = replace(specs[k], step=specs[k].step * 2)
    else:
        return sobol_grid(spark, parameters, most)
    out, rest = [], F.col("id")
    for p, n in zip(reversed(specs), reversed(sizes), strict=True):
        value = F.lit(float(p.least)) + (rest % n) * float(p.step) if p.step > 0 else F.lit(float(p.default))
        out.append(F.bround(value, 0).cast("long").alias(p.name) if p.whole else F.round(value, 6).alias(p.name))
        rest = F.floor(rest / n)
    return spark.range(math.prod(sizes)).select(*reversed(out))


def sobol_grid(spark: SparkSession, parameters: list[Parameter], samples: int = 500, *, seed: int | None = 42) -> DataFrame:
    """The defaults, then points of the Sobol sequence (ten parameters at most) scaled to the parameters' ranges, snapped to their steps; seed: of the digital shift, None without one."""
    if len(parameters) > len(DIRECTIONS) + 1:
        raise ValueError(f"at most {len(DIRECTIONS) + 1} parameters")
    import random

    shifts = [random.Random(f"{seed} {i}").getrandbits(BITS) if seed is not None else 0 for i in range(len(parameters))]
    cells = []
    for i, p in enumerate(parameters):
        u = sobol(F.col("id") - 1, i, shifts[i])
        scaled = F.exp(math.log(p.least) + u * (math.log(p.most) - math.log(p.least))) if p.log and p.least > 0 else p.least + u * (p.most - p.least)
        default = F.lit(p.default).cast("long" if p.whole else "double")
        cells.append(F.when(F.col("id") == 0, default).otherwise(_set(p, scaled)).alias(p.name))
    return spark.range(max(1, samples) if parameters else 1).select(*cells or [F.col("id")])


def neighbours(points: DataFrame, parameters: list[Parameter], *, steps: int = 1) -> DataFrame:
    """Of each point those that differ in one parameter by 1 to `steps` steps either way, within its ends, each once and without the point itself."""
    names = [p.name for p in parameters]
    moved = []
    for p in parameters:
        for k in (k for k in range(-steps, steps + 1) if k and p.step > 0):
            value = F.greatest(F.lit(float(p.least)), F.least(F.col(p.name) + k * float(p.step), F.lit(float(p.most))))
            value = F.bround(value, 0).cast("long") if p.whole else F.round(value, 6)
            moved.append(F.struct(*[(value if q == p.name else F.col(q)).alias(q) for q in names]))
    if not moved:
        return points.select(*names).limit(0)
    rows = points.select(F.struct(*names).alias("_p"), F.explode(F.array(*moved)).alias("_q"))
    return rows.where(F.col("_p") != F.col("_q")).select("_q.*").distinct()
