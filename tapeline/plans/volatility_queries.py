"""Queries over volatility and tails: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from ..functions.distributions import QUANTILE
from ..operators import volatility as v
from .trade_queries import QUERIES, query
from .views import trades


def _quantile_sql(p: str) -> str:
    """DuckDB: the standard normal quantile by the same rational functions."""
    poly = lambda c, x: "(" + " + ".join(f"{a!r} * pow({x}, {k})" for k, a in enumerate(c)) + ")"
    part = lambda i, x: f"{poly(QUANTILE[i][0], x)} / {poly(QUANTILE[i][1], x)}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {part(0, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
        f"ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {part(1, f'({r} - 1.6)')} ELSE {part(2, f'({r} - 5)')} END END)")


def w41_garch(spark, d):
    """GARCH(1,1) of each strategy's R; an optimiser has no SQL, tests hold it against a grid."""
    return v.clustering(trades(spark, d))


QUERIES["w41_garch"] = w41_garch


_HILL = """, a AS (SELECT strategy, abs(r_multiple) AS x FROM trades WHERE abs(r_multiple) > 1e-12), o AS (SELECT strategy, x, count(*) OVER (PARTITION BY strategy) AS n,
 row_number() OVER (PARTITION BY strategy ORDER BY x DESC) - 1 AS k,
 sum(ln(x)) OVER (PARTITION BY strategy ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM a),
h AS (SELECT strategy, n, k, s / k - ln(x) AS hill FROM o WHERE n >= 10 AND k >= greatest(5, floor(0.05 * n)) AND k <= greatest(floor(0.30 * n), greatest(5, floor(0.05 * n)) + 1)
 AND s / k - ln(x) > 1e-12)"""


@query(_HILL + " SELECT strategy, n, k, round(hill + 1.37E-7, 6) AS hill FROM h")
def t15_hill_plot(spark, d):
    df = v.hill_plot(trades(spark, d))
    return df.withColumn("hill", v.rounded(df["hill"], 6))


@query(_HILL + """ SELECT strategy, count(*) AS points, round(median(hill) + 1.37E-7, 4) AS tail_index, round(1 / median(hill) + 1.37E-7, 4) AS tail_exponent,
 1 / median(hill) > 2 AS finite_variance FROM h GROUP BY strategy""")
def t15_tail_index(spark, d):
    return v.tail_index(trades(spark, d))


@query(""", m AS (SELECT strategy, avg(r_multiple) AS mu, stddev_samp(r_multiple) AS sd, quantile_cont(r_multiple, 0.05) AS q FROM trades GROUP BY strategy),
c AS (SELECT t.strategy, avg(pow(r_multiple - mu, 3)) AS c3, avg(pow(r_multiple - mu, 4)) AS c4 FROM trades t JOIN m USING (strategy) GROUP BY t.strategy),
w AS (SELECT t.strategy, avg(r_multiple) AS cvar FROM trades t JOIN m ON m.strategy = t.strategy AND r_multiple <= q GROUP BY t.strategy),
z AS (SELECT m.*, cvar, -1.6448536269514722E0 AS z, c3 / pow(sd, 3) AS s, c4 / pow(sd, 4) - 3 AS k FROM m JOIN c USING (strategy) JOIN w USING (strategy)),
v AS (SELECT *, mu + z * sd AS nv, mu + (z + (z * z - 1) * s / 6 + (pow(z, 3) - 3 * z) * k / 24 - (2 * pow(z, 3) - 5 * z) * s * s / 36) * sd AS cf FROM z)
SELECT strategy, round(nv + 1.37E-7, 4) + 0.0E0 AS normal_var, round(q + 1.37E-7, 4) + 0.0E0 AS historical_var, round(cf + 1.37E-7, 4) + 0.0E0 AS cornish_fisher_var,
 round(cvar + 1.37E-7, 4) + 0.0E0 AS cvar, CASE WHEN nv <= q AND nv <= cf THEN 'normal' WHEN q <= cf THEN 'historical' ELSE 'cornish_fisher' END AS most_conservative,
 round(CASE WHEN abs(q) > 1e-12 THEN 100 * (nv - q) / abs(q) ELSE 0 END + 1.37E-7, 2) + 0.0E0 AS normal_underestimate_pct FROM v""")
def t15_value_at_risk(spark, d):
    return v.value_at_risk(trades(spark, d))


@query(""", n AS (SELECT strategy, r_multiple, CAST(row_number() OVER (PARTITION BY strategy ORDER BY r_multiple) AS BIGINT) AS no, count(*) OVER (PARTITION BY strategy) AS n,
 avg(r_multiple) OVER (PARTITION BY strategy) AS mu, stddev_samp(r_multiple) OVER (PARTITION BY strategy) AS sd FROM trades), p AS (SELECT *, (no - 0.5E0) / n AS p FROM n)
SELECT strategy, no, round(""" + _quantile_sql("p") + """ + 1.37E-7, 4) + 0.0E0 AS theoretical, round((r_multiple - mu) / sd + 1.37E-7, 4) + 0.0E0 AS empirical FROM p""")
def t15_quantile_pairs(spark, d):
    return v.quantile_pairs(trades(spark, d))
