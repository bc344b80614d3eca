"""How good a filter by predicted chances is (Q2-Q8). Predictions have predicted_prob, threshold, was_filtered; those with an outcome also actual_outcome, r_multiple, pnl_usd.

Blocking a trade that does not win, or passing one that does, is right. Bins and counts of distinct chances keep every sort small; the ROC curve's
running counts go over cells of chances, so no task holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio, rounded


def _won() -> Column:
    return F.col("actual_outcome") == "win"


def _right() -> Column:
    return F.col("was_filtered") != _won()


def filter_counts(predictions: DataFrame) -> DataFrame:
    """Q2: predictions logged, blocked, passed and with a known outcome."""
    n, blocked, known = F.count("*"), F.sum(F.col("was_filtered").cast("long")), F.count("actual_outcome")
    return predictions.agg(n.alias("logged"), blocked.alias("blocked"), (n - blocked).alias("passed"), known.alias("reconciled"), rounded(ratio(known,
        n)).alias("reconciled_share"))


def filter_quality(known: DataFrame, *by: str) -> DataFrame:
    """Q3/Q6 in one pass: accuracy, precision and recall of blocking, Brier score, and the money and R that blocking saved and missed; by any keys."""
    p, y, lost = F.col("predicted_prob"), _won().cast("double"), F.col("was_filtered") & ~_won()
    blocked, missed = F.sum(F.col("was_filtered").cast("long")), F.col("was_filtered") & _won()

    def total(cond: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.abs(c))), F.lit(0.0))

    money, money_missed, r, r_missed = total(lost & (F.col("pnl_usd") < 0), "pnl_usd"), total(missed & (F.col("pnl_usd") > 0),
        "pnl_usd"), total(lost & (F.col("r_multiple") < 0), "r_multiple"), total(missed & (F.col("r_multiple") > 0), "r_multiple")
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), rounded(F.avg(_right().cast("double"))).alias("accuracy"), rounded(F.coalesce(ratio(F.sum(lost.cast("long")), blocked),
            F.lit(0.0))).alias("precision"),
        rounded(F.coalesce(ratio(F.sum(lost.cast("long")), F.sum((~_won()).cast("long"))), F.lit(0.0))).alias("recall"), rounded(F.avg(F.pow(p - y, 2))).alias("brier_score"),
        rounded(money, 2).alias("saved_usd"), rounded(money_missed, 2).alias("missed_usd"), rounded(money - money_missed,
            2).alias("net_usd"), rounded(r).alias("saved_r"), rounded(r_missed).alias("missed_r"), rounded(r - r_missed).alias("net_r"),
    )


def calibration(known: DataFrame, bins: int = 10) -> DataFrame:
    """Q4: per bin of chances their number, mean chance and share of wins; empty bins have 0 and nulls."""
    at = F.least(F.floor(F.col("predicted_prob") * bins), F.lit(bins - 1)).cast("int")
    cells = known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), rounded(F.avg("predicted_prob")).alias("mean_prob"),
        rounded(F.avg(_won().cast("double"))).alias("win_rate"))
    return known.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(cells, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _prefix(df: DataFrame, columns: list[str], cells: int = 4096) -> DataFrame:
    """df (predicted_prob, columns) with the sums `c_...` of all rows of at least its chance: totals of cells of equal width, and running sums inside a cell."""
    df = df.withColumn("_cell", F.floor(F.col("predicted_prob") * cells))
    totals = df.groupBy("_cell").agg(*[F.sum(c).alias(f"_t{c}") for c in columns])
    before = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most `cells` rows
    totals = totals.select("_cell", *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in columns])
    inside = Window.partitionBy("_cell").orderBy(F.desc("predicted_prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(F.broadcast(totals), "_cell").select("predicted_prob", *columns, *[(F.col(f"_b{c}") + F.sum(c).over(inside)).alias(f"c_{c}") for c in columns])


def roc_points(known: DataFrame) -> DataFrame:
    """Q5: for each distinct chance as threshold (kept: at least it) the rates of true and false positives, with precision; a win is positive."""
    per = known.groupBy("predicted_prob").agg(F.sum(_won().cast("long")).alias("pos"), F.sum((~_won()).cast("long")).alias("neg"))
    all_ = per.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    df = _prefix(per, ["pos", "neg"]).join(F.broadcast(all_))  # one row
    return df.select("predicted_prob", "pos", "neg", ratio(F.col("c_pos"), F.col("_p")).alias("tpr"), ratio(F.col("c_neg"), F.col("_n")).alias("fpr"),
        ratio(F.col("c_pos"), F.col("c_pos") + F.col("c_neg")).alias("precision"), "c_pos", "c_neg", "_p", "_n")


def areas(known: DataFrame) -> DataFrame:
    """Q1/Q3: exact area under the ROC curve (ties count half) and average precision."""
    df = roc_points(known)
    # of each chance: its losses stand against all wins of higher chances, and half of its own
    auc = ratio(F.sum(F.col("neg") * (F.col("c_pos") - F.col("pos") / 2)), F.max(F.col("_p") * F.col("_n")))
    return df.agg(rounded(auc).alias("roc_auc"), rounded(F.sum(ratio(F.col("pos"), F.col("_p")) * F.col("precision"))).alias("pr_auc"))


def histogram(known: DataFrame, bins: int = 20) -> DataFrame:
    """Q7: counts by bin of chances and outcome."""
    at = F.least(F.floor(F.col("predicted_prob") * bins), F.lit(bins - 1)).cast("int")
    return known.groupBy(at.alias("bin"), "actual_outcome").agg(F.count("*").alias("n"))


def modal_threshold(known: DataFrame) -> DataFrame:
    """Q7: the threshold that most rows have; of equally frequent ones the smallest."""
    return known.groupBy("threshold").count().agg(F.max(F.struct("count", (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("threshold"),
        F.col("m.count").alias("n"))


def rolling_accuracy(known: DataFrame, *, by: str = "strategy", time: str = "prediction_ts", window: int = 30) -> DataFrame:
    """Q8: share of right decisions among the last `window`, null before a third of them (5 at least)."""
    frame = Window.partitionBy(by).orderBy(time).rowsBetween(-(window - 1), 0)
    right = _right().cast("double")
    return known.select(by, time, F.when(F.count("*").over(frame) >= max(5, window // 3), F.avg(right).over(frame)).alias("rolling_accuracy"))


def drift(known: DataFrame, *, by: str = "strategy", time: str = "prediction_ts", window: int = 30, threshold: float = 0.5) -> DataFrame:
    """Q8: the last window's accuracy, its trend (second half against first, by more than 0.05), and whether it lies below the threshold."""
    w = Window.partitionBy(by).orderBy(F.desc(time))
    last = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= window).select(by, "_n", _right().cast("double").alias("_r"))
    late, early = F.avg(F.when(F.col("_n") <= window // 2, F.col("_r"))), F.avg(F.when(F.col("_n") > window // 2, F.col("_r")))
    trend = F.when(late - early > 0.05, "improving").when(early - late > 0.05, "degrading").otherwise("stable")
    return last.groupBy(by).agg(F.count("*").alias("n"), rounded(F.avg("_r")).alias("accuracy"), trend.alias("trend"), (F.avg("_r") < threshold).alias("drifting"))


def verdict(known: DataFrame) -> DataFrame:
    """Q8: whether the filter gives an edge: 30 rows, an accuracy of 0.55 and a positive net value."""
    q = filter_quality(known)
    return q.select("n", "accuracy", "net_usd", "net_r", F.when(F.col("n") < 30, "insufficient").when((F.col("accuracy") >= 0.55) & (F.col("net_usd") > 0),
        "edge").otherwise("no edge").alias("verdict"))
