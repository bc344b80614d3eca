"""Distribution functions as column expressions, for the few rows that aggregations leave: no Python runs on them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms). Fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def normal_cdf(x: Column) -> Column:
    """Of the standard normal distribution: a power series to 3 standard deviations, a continued fraction beyond."""
    size, density = F.abs(x), F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    terms = F.sequence(F.lit(1), F.lit(60))
    series = F.aggregate(terms, F.struct(x.alias("t"), x.alias("s")), lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
    tail = density / (size + F.aggregate(terms, F.lit(0.0), lambda f, k: (61 - k) / (size + f)))
    return F.when(size < 3, 0.5 + density * series).when(x > 0, 1 - tail).otherwise(tail)


def normal_two_sided(z: Column) -> Column:
    """Chance of a standard normal value at least as far from 0."""
    return 2 * normal_cdf(-F.abs(z))


#: Rational approximations of the normal quantile (Wichura's AS 241): numerators and denominators, constant term first, for the middle, the shoulders and the
#: far tails. Fixed values.
QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
        3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
        5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
        2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2,
        5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
        2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5,
        1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def normal_quantile(p: Column) -> Column:
    """The value that a standard normal variable stays below with chance p (between 0 and 1)."""

    def rational(parts: tuple, x: Column) -> Column:
        top, low = (F.lit(c[-1]) for c in parts)
        for a, b in zip(parts[0][-2::-1], parts[1][-2::-1], strict=True):
            top, low = top * x + a, low * x + b
        return top / low

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, rational(QUANTILE[1], r - 1.6)).otherwise(rational(QUANTILE[2], r - 5))
    return F.when(F.abs(q) <= 0.425, q * rational(QUANTILE[0], 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def lgamma(z: Column) -> Column:
    """Log of the gamma function for z >= 0.5."""
    x, base = z - 1, z + 6.5
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + i)
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.ln(base) - base + F.ln(total)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction (Lentz), with as many steps as the square root of the parameters asks for."""

    def part(a: Column, b: Column, x: Column) -> Column:
        tiny = 1e-300
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        start = F.struct(F.lit(1.0).alias("c"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("d"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("h"))

        def half(s: Column, top: Column) -> Column:
            c, d = safe(1 + top / s["c"]), 1 / safe(1 + top * s["d"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        steps = F.sequence(F.lit(1), (60 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
        even = lambda s, m: half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        odd = lambda s, m: half(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        # a struct's fields are named once per step, so that the expression does not double in each
        folded = F.aggregate(F.transform(F.sequence(F.lit(2), 2 * F.size(steps) + 1), lambda k: k), start, lambda s, k: F.when(k % 2 == 0, even(s, (k / 2).cast("int").cast("double"))).otherwise(odd(s, ((k - 1) / 2).cast("int").cast("double"))))
        return front * folded["h"]

    near = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(near, part(a, b, x)).otherwise(1 - part(b, a, 1 - x)))


def t_two_sided(t: Column, df: Column) -> Column:
    """Chance of a t value at least as far from 0 with df degrees of freedom."""
    v = df.cast("double")
    return beta_inc(v / 2, F.lit(0.5), v / (v + t * t))


def t_quantile(p: Column, df: Column) -> Column:
    """The value that a t variable stays below with chance p (0.5 or more), by bisection."""
    low_high = F.struct(F.lit(0.0).alias("a"), F.lit(1000.0).alias("b"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        high = t_two_sided(mid, df) / 2 > 1 - p
        return F.struct(F.when(high, mid).otherwise(s["a"]).alias("a"), F.when(high, s["b"]).otherwise(mid).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), low_high, step, lambda s: (s["a"] + s["b"]) / 2)


def binomial_at_least(k: Column, n: Column) -> Column:
    """Chance of k or more of n even coin tosses."""
    k, n = k.cast("double"), n.cast("double")
    return F.when(k <= 0, 1.0).otherwise(beta_inc(F.greatest(k, F.lit(1.0)), n - k + 1, F.lit(0.5)))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution: the series of the lower incomplete gamma function up to about the mean, the continued fraction of the upper one
    beyond it; both take steps with the square root of df."""
    a, y = df.cast("double") / 2, x / 2
    steps = F.sequence(F.lit(1), (80 + 10 * F.sqrt(a)).cast("int"))
    front = F.exp(a * F.ln(y) - y - lgamma(a + 1))

    def term(s: Column, k: Column) -> Column:
        t = s["t"] * y / (a + k)
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    lower = front * F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), term, lambda s: s["s"])
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def deeper(s: Column, k: Column) -> Column:
        top, low = k * (a - k), y + 2 * k + 1 - a
        c, d = safe(low + top / s["c"]), 1 / safe(low + top * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    d = 1 / safe(y + 1 - a)
    start = F.struct(F.lit(1e300).alias("c"), d.alias("d"), d.alias("h"))
    upper = front * a * F.aggregate(steps, start, deeper, lambda s: s["h"])
    return F.when(y <= 0, 1.0).when(y < a + 1, F.greatest(F.lit(0.0), 1 - lower)).otherwise(F.least(F.lit(1.0), upper))


def kolmogorov_sf(x: Column) -> Column:
    """Chance of a scaled Kolmogorov-Smirnov distance of x or more, in the limit of large samples."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))
