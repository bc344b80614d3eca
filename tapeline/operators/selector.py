"""Which strategy to follow, learned from the state of the market at the end of a day, and what the choice rests on.

A row is a market and a day. Everything that a model learns from was known before the first day that it predicts: its rows end `embargo` days before that day, by
default the days that a label looks ahead. The number of days bounds what goes through one task (one row a day); rows of many markets stay spread."""

from __future__ import annotations

import math
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import correlation, ratio, rounded
from ..functions.storage import cut, shared
from .joins import overlap_long
from .ordering import ranked
from .portfolio import best_label

REGIMES = ("trending_up", "trending_down", "ranging", "volatile")  # one column each; 'unknown' has none
KEYS = ("symbol", "day")
BINS = 32  # of a feature, as Spark's forests have them
AT_ONCE = 8  # forests of one tree that are grown at the same time


def selector_rows(features: DataFrame, regimes: DataFrame, daily: DataFrame, *, columns: tuple[str, ...], days: int = 7) -> DataFrame:
    """Symbol, day, `columns` and regime flags at the day's last bar, `forward` (R of each strategy over the next `days` days with a trade of any) and `label`, the
    strategy with the largest one ('none' where no one is above 0, ties: the first by name).

    features: symbol, bar_ts, columns; regimes: symbol, bar_ts, regime; daily: strategy, day, r. Days without `days` days after them have no label and are left out, as are
    rows of which half the features or more are missing; other missing ones are 0. Null labels, empty tables: no rows."""
    day = F.to_date("bar_ts").cast("string")
    last = features.groupBy("symbol", day.alias("day")).agg(F.max("bar_ts").alias("bar_ts"))
    at = features.join(last, ["symbol", "bar_ts"]).join(regimes.select("symbol", "bar_ts", "regime"), ["symbol", "bar_ts"], "left")
    flags = {f"regime_{x}": F.coalesce((F.col("regime") == x).cast("double"), F.lit(0.0)) for x in REGIMES}
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    at = at.where(2 * missing < len(columns) + len(REGIMES))
    at = at.select("symbol", "day", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], *[v.alias(k) for k, v in flags.items()])
    ahead = Window.partitionBy("strategy").orderBy("day").rowsBetween(1, days)
    forward = overlap_long(daily, outer=True).withColumn("_n", F.count("*").over(ahead)).withColumn("forward_r", F.sum("r").over(ahead)).where(F.col("_n") == days)
    sums = forward.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "forward_r")))).alias("forward"))  # a value a strategy
    return at.join(sums, "day").join(best_label(forward).select("day", "label"), "day").select(*KEYS, *columns, *flags, "forward", "label")


def prepared(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with `day_no` (from 1) and `features`, and the classes that labels have (strategies and 'none'), by name."""
    days = rows.select("day").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("day")))  # one row a day
    df = cut(VectorAssembler(inputCols=columns, outputCol="features").transform(rows.join(days, "day")))
    return df, sorted(r["label"] for r in df.select("label").distinct().collect())  # one row a strategy


def fitted(rows: DataFrame, classes: list[str], *, keys: tuple[str, ...] = KEYS, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel | None:
    """A forest over prepared rows in which each class has the same weight in total; None without rows. The rows are dealt and ordered by their keys, so reruns agree."""
    counts = rows.groupBy("label").agg(F.count("*").alias("_k")).withColumn("_weight", F.lit(1.0) / F.col("_k"))
    n, k = counts.agg(F.sum("_k"), F.count("*")).first()
    if not n:
        return None
    indexer = StringIndexerModel.from_labels(classes if len(classes) > 1 else [*classes, ""], inputCol="label", outputCol="target")
    df = rows.join(counts, "label").withColumn("_weight", F.col("_weight") * (n / k))
    df = df.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return RandomForestClassifier(labelCol="target", featuresCol="features", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed).fit(indexer.transform(df))


def predicted(rows: DataFrame, model: RandomForestClassificationModel, classes: list[str]) -> DataFrame:
    """Prepared rows with `predicted`, the likeliest class (ties: the first by name), and `chances`, class by class."""
    df = model.transform(rows).withColumn("chances", F.slice(vector_to_array("probability"), 1, len(classes)))  # a forest has two classes at least
    names = F.array(*[F.lit(c) for c in classes])
    best = F.element_at(names, F.array_position("chances", F.array_max("chances")).cast("int"))
    return df.withColumn("predicted", best).drop("rawPrediction", "probability", "prediction")


def folds(n_days: int, *, held_out: float = 0.2, embargo: int) -> list[tuple[str, int, int, int]]:
    """(name, last training day, first and last day judged): equal stretches at the end of the training days, each judged by all before it, then the held-out days."""
    split = int(n_days * (1 - held_out))
    k = min(5, max(2, split // 30))
    size = split // (k + 1)
    cuts = [(f"fold {i + 1}", split - (k - i) * size, split - (k - i - 1) * size) for i in range(k)] + [("held out", split, n_days)]
    return [(name, first - embargo, first + 1, last) for name, first, last in cuts if last > first]


def training(rows: DataFrame, columns: list[str], *, held_out: float = 0.2, embargo: int = 7, **forest) -> DataFrame:
    """Part, label, predicted, n, and the part's accuracy and training rows, for folds in time order and the days held out. Parts without training rows are left out."""
    df, classes = prepared(rows, columns)
    n_days = df.agg(F.max("day_no")).first()[0] or 0
    out = None
    for name, until, first, last in folds(n_days, held_out=held_out, embargo=embargo):
        past = df.where(F.col("day_no") <= until)
        if model := fitted(past, classes, **forest):
            got = predicted(df.where(F.col("day_no").between(first, last)), model, classes).groupBy("label", "predicted").agg(F.count("*").alias("n"))
            got = got.select(F.lit(name).alias("part"), "label", "predicted", "n", F.lit(past.count()).alias("n_train"))
            out = got if out is None else out.union(got)
    if out is None:
        return rows.sparkSession.createDataFrame([], "part string, label string, predicted string, n long, n_train long, accuracy double")
    part = Window.partitionBy("part")  # at most classes squared rows
    return out.withColumn("accuracy", rounded(ratio(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).over(part), F.sum("n").over(part))))


def walk_forward(rows: DataFrame, columns: list[str], *, least: int = 60, every: int = 20, embargo: int = 7, **forest) -> DataFrame:
    """Each day from the `least`-th on with the class that a forest of the days before it picks, refitted every `every` days, its chances, and the forward R of following
    it (hard), of weights by chance (soft; 'none' stays in cash), of equal weights and of the best strategy in hindsight. Fewer than least + 10 days: no rows."""
    df, classes = prepared(rows, columns)
    n_days = df.agg(F.max("day_no")).first()[0] or 0
    out = None
    for start in range(least, n_days, every) if n_days >= least + 10 else ():
        if model := fitted(df.where(F.col("day_no") <= start - embargo), classes, **forest):
            got = predicted(df.where((F.col("day_no") > start) & (F.col("day_no") <= start + every)), model, classes)
            got = got.withColumn("trained_to", F.lit(start - embargo))
            out = got if out is None else out.union(got)
    if out is None:
        out = df.where("false").withColumns({"chances": F.array().cast("array<double>"), "predicted": F.lit(""), "trained_to": F.lit(0)})
    worth = F.map_values("forward")
    soft = sum((F.col("chances")[i] * F.coalesce(F.col("forward")[c], F.lit(0.0)) for i, c in enumerate(classes) if c != "none"), F.lit(0.0))
    total = F.aggregate(worth, F.lit(0.0), lambda a, x: a + x)
    return out.select(*KEYS, "day_no", "trained_to", "label", "predicted", F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), "chances").alias("chances"),
        F.coalesce(F.col("forward")[F.col("predicted")], F.lit(0.0)).alias("hard"), soft.alias("soft"), (total / F.size(worth)).alias("equal"), F.array_max(worth).alias("best"))


def win_confidence(trades: DataFrame, columns: list[str], *, until, key: str = "trade_id", time: str = "entry_time", end: str = "exit_time", missing: float = -1.0, least: int = 100_000,
                   **forest) -> DataFrame:
    """Q9: the chance to win that a forest over trades closed before `until` gives to those entered from then on; missing features are `missing`.

    trades: key, time, end, is_win (null: neither learned from nor left out of scoring), columns. Wins only in the past: 1, no win there: 0, no past at all: null.
    From `least` past trades on, those in the same bins of all features with the same label are one row with a number, if that leaves a quarter of the rows or less."""
    df = trades.select(key, time, end, "is_win", *[F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(c) for c in columns])
    df = df.withColumn("label", F.when(F.col("is_win"), "win").otherwise("loss"))
    past, later = df.where((F.col(end) < until) & F.col("is_win").isNotNull()), df.where(F.col(time) >= until)
    if (n := past.count()) >= least:
        bins = in_bins(past, columns)
        cells = cut(bins.transform(past).groupBy(F.array(*bins.getOutputCols()).alias("x"), "label").agg(F.count("*").alias("n")))
        if 4 * cells.count() <= n:
            later = bins.transform(later).select(key, "is_win", F.array(*bins.getOutputCols()).alias("x"))
            return later.join(cell_chances(cells, later.select("x").distinct(), "win", **forest), "x").select(key, "is_win", F.col("chance").alias("confidence"))
    past, later = (VectorAssembler(inputCols=columns, outputCol="features").transform(x) for x in (past, later))
    classes = sorted(r["label"] for r in past.select("label").distinct().collect())  # two at most
    model = fitted(past, classes, keys=(key,), **forest)
    if model is None:
        return later.select(key, "is_win", F.lit(None).cast("double").alias("confidence"))
    win = F.col("chances")[classes.index("win")] if "win" in classes else F.lit(0.0)
    return predicted(later, model, classes).select(key, "is_win", win.alias("confidence"))


def in_bins(rows: DataFrame, columns: list[str]) -> Bucketizer:
    """Each column in at most BINS bins (column: _bin_ and its name), the number that a forest tells apart: a bin a value where there are no more values, else quantiles of all rows."""
    splits = []
    for c in columns:
        given = rows.where(~F.isnan(c)).select(c)  # NaN has a bin of its own
        values = sorted(r[c] for r in given.distinct().limit(BINS + 1).collect())
        if len(values) > BINS:
            cuts = given.agg(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10_000).alias("at")).first()["at"]
        else:
            cuts = [(a + b) / 2 for a, b in zip(values, values[1:])] or [0.0]  # a Bucketizer has two bins at least
        splits.append(sorted({-math.inf, *cuts, math.inf}))
    return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[f"_bin_{c}" for c in columns], handleInvalid="keep")


def cell_chances(cells: DataFrame, asked: DataFrame, of: str, *, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """Distinct x with `chance`, that of class `of` by a forest over cells: x (an array of bins), label (two at most), n (rows in the cell). Each class has the same weight in total.

    A forest draws each row a Poisson(1) number of times for each tree, so a cell of n rows Poisson(n) times: this is drawn here, by hashes of the cells, and each tree is
    Spark's forest of one tree over the cells drawn. Work and memory follow the number of cells, not of rows."""
    spark = cells.sparkSession
    sums = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a class
    classes, n = sorted(sums), sum(sums.values())
    if len(classes) < 2:
        return asked.select("x", F.lit(float(of in sums)).alias("chance"))
    exact = 1 << 20  # weights in whole parts of it: sums of them do not depend on their order
    weight = F.element_at(F.create_map(*[F.lit(v) for c in classes for v in (c, max(1, round(n / len(classes) / sums[c] * exact)) / exact)]), F.col("label"))

    @F.pandas_udf("array<bigint>")
    def drawn(h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.Generator(np.random.SFC64(int(a) & (1 << 64) - 1)).poisson(k, trees) for a, k in zip(h, n)])

    parts = 1 + cells.count() // 20_000
    bags = cells.select("x", "label", array_to_vector("x").alias("features"), weight.alias("_weight"), drawn(F.xxhash64(F.lit(seed), "x", "label"), "n").alias("_times"))
    bags = cut(bags.repartition(parts, "x", "label").sortWithinPartitions("x", "label"))
    bags = StringIndexerModel.from_labels(classes, inputCol="label", outputCol="target").transform(bags)

    def grown(tree: int) -> RandomForestClassificationModel:
        bag = bags.select("features", "target", (F.get("_times", F.lit(tree)) * F.col("_weight")).alias("_w")).where("_w > 0")
        one = RandomForestClassifier(labelCol="target", weightCol="_w", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxBins=BINS + 1, maxDepth=depth, seed=seed + tree)
        return one.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p").fit(bag)

    with ThreadPool(AT_ONCE) as pool:
        models = pool.map(inheritable_thread_target(spark)(grown), range(trees), chunksize=1)
    out = cut(asked.select("x", array_to_vector("x").alias("features"), F.lit(0.0).alias("chance")))
    for i in range(0, trees, 10):  # ten trees a plan
        for model in models[i : i + 10]:
            out = model.transform(out).withColumn("chance", F.col("chance") + vector_to_array("_p")[classes.index(of)]).drop("_p")
        out = cut(out)
    return out.select("x", (F.col("chance") / trees).alias("chance"))


def walk_metrics(walk: DataFrame) -> DataFrame:
    """Per market and way of choosing: days, total and mean R, Sharpe ratio (365 days), worst drop of the running sum below its peak, share of days above 0, accuracy."""
    ways = F.explode(F.array(*[F.struct(F.lit(c).alias("way"), F.col(c).alias("r")) for c in ("hard", "soft", "equal", "best")]))
    df = walk.select(*KEYS, (F.col("label") == F.col("predicted")).cast("double").alias("hit"), ways.alias("w")).select(*KEYS, "hit", "w.way", "w.r")
    up = Window.partitionBy("symbol", "way").orderBy("day")  # one row a day
    df = df.withColumn("_sum", F.sum("r").over(up)).withColumn("_drop", F.col("_sum") - F.max("_sum").over(up))
    sd = F.stddev_samp("r")
    return df.groupBy("symbol", "way").agg(F.count("*").alias("days"), rounded(F.sum("r")).alias("total_r"), rounded(F.avg("r"), 6).alias("mean_r"),
        rounded(F.when(sd > 0, F.avg("r") / sd * 365**0.5).otherwise(0.0)).alias("sharpe"), rounded(F.min("_drop")).alias("max_drawdown"),
        rounded(F.avg((F.col("r") > 0).cast("double"))).alias("win_rate"), rounded(F.avg("hit")).alias("accuracy"))


def nodes(model: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """The trained trees as a table, a row a node: tree, node, left, right (-1 at a leaf), feature, threshold (left: at most it), shares of the classes.

    Spark's own saved form, written to the shared checkpoint folder and read again."""
    where = f"{shared(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(where)
    d = F.col("nodeData")
    whole = F.aggregate(d["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{where}/data").select(F.col("treeID").alias("tree"), d["id"].alias("node"), d["leftChild"].alias("left"), d["rightChild"].alias("right"),
        d["split"]["featureIndex"].alias("feature"), F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        F.transform(d["impurityStats"], lambda x: x / whole).alias("shares"))


def contributions(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Prepared rows' keys with `base` (class shares at the roots), `parts` (feature by class, what the steps of all trees on that feature changed) and `chances`.

    base plus the sum of parts over features is chances. The nodes, at most trees times 2 ** (depth + 1), are broadcast; a batch of 1,000 rows is held at a time."""
    import numpy as np

    flat = nodes(model, rows.sparkSession).orderBy("tree", "node").toPandas()
    first = flat.groupby("tree")["node"].transform("size").groupby(flat["tree"]).first().cumsum().shift(fill_value=0)  # a tree's nodes are numbered from 0
    offset = flat["tree"].map(first).to_numpy()
    leaf = flat["left"].to_numpy() < 0
    left, right = (np.where(leaf, np.arange(len(flat)), flat[c].to_numpy() + offset) for c in ("left", "right"))
    feature, threshold = np.where(leaf, 0, flat["feature"].to_numpy()), np.where(leaf, np.inf, flat["threshold"].fillna(np.inf).to_numpy(float))
    shares = np.array(flat["shares"].tolist(), float)
    tree = rows.sparkSession.sparkContext.broadcast((first.to_numpy(), left, right, feature, threshold, shares, leaf))
    n_features, depth = model.numFeatures, max(t.depth for t in model.trees)

    def walk(batches):
        import numpy as np
        import pandas as pd

        roots, left, right, feature, threshold, shares, leaf = tree.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                df = whole.iloc[at : at + 1000]
                x = np.array(df["x"].tolist(), float)
                i, n, k = np.arange(len(df))[:, None], len(df), shares.shape[1]
                parts, now = np.zeros((n * n_features, k)), np.broadcast_to(roots, (n, len(roots)))
                for _ in range(depth):
                    f = feature[now]
                    then = np.where(x[i, f] <= threshold[now], left[now], right[now])
                    cell = (i * n_features + f).ravel()
                    step = (shares[then] - shares[now]).reshape(-1, k) / len(roots)
                    for c in range(k):
                        parts[:, c] += np.bincount(cell, step[:, c], n * n_features)
                    now = then
                yield pd.DataFrame({"symbol": df["symbol"], "day": df["day"], "x": df["x"], "base": [shares[roots].mean(0).tolist()] * n,
                    "parts": parts.reshape(n, n_features, k).tolist(), "chances": shares[now].mean(1).tolist()})

    given = rows.select(*KEYS, vector_to_array("features").alias("x"))
    return given.mapInPandas(walk, "symbol string, day string, x array<double>, base array<double>, parts array<array<double>>, chances array<double>")


def permuted_accuracy(rows: DataFrame, model: RandomForestClassificationModel, columns: list[str], classes: list[str], *, seed: int = 42) -> DataFrame:
    """Feature, loss: how much accuracy falls where each row has the value of the next row by hash for one feature (the last row that of the first).

    Rows are numbered by ranges of their hash, so no task sees them all; all features are scored in one job."""
    keyed = ranked(rows.select(*KEYS, "label", vector_to_array("features").alias("x")).withColumn("_h", F.xxhash64(F.lit(seed), *KEYS)), [], "_h", ties=KEYS)
    keyed = cut(keyed)
    n = keyed.count()
    other = keyed.select(F.when(F.col("no") == 1, n).otherwise(F.col("no") - 1).alias("no"), F.col("x").alias("_y"))
    each = keyed.join(other, "no").withColumn("f", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))))  # -1: nothing changed
    mixed = F.transform("x", lambda v, i: F.when(i == F.col("f"), F.get("_y", i)).otherwise(v))
    hit = predicted(each.withColumn("features", array_to_vector(mixed)), model, classes).groupBy("f").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a"))
    whole = hit.where("f = -1").select(F.col("a").alias("_whole"))
    names = F.array(*[F.lit(c) for c in columns])
    return hit.where("f >= 0").crossJoin(F.broadcast(whole)).select(F.get(names, "f").alias("feature"), (F.col("_whole") - F.col("a")).alias("loss"))  # whole: one row


def importance(rows: DataFrame, columns: list[str], *, seed: int = 42, **forest) -> DataFrame:
    """A forest over all rows, and per feature the mean size of its contributions over rows and classes, their correlation with the feature's value for the class
    whose contributions vary most, the direction that it has where beyond 0.3, the trees' own gain and the loss of accuracy when its values are dealt anew."""
    df, classes = prepared(rows, columns)
    kind = "feature string, importance double, rank int, class string, correlation double, direction string, gain double, accuracy_loss double"
    model = fitted(df, classes, seed=seed, **forest)
    if model is None:
        return rows.sparkSession.createDataFrame([], kind)
    names, labels = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(c) for c in classes])
    cells = contributions(df, model).select(F.posexplode("parts").alias("f", "of"), "x").select("f", F.get("x", "f").alias("v"), F.posexplode("of").alias("c", "p"))
    cells = cells.groupBy("f", "c").agg(F.avg(F.abs("p")).alias("size"), F.var_pop("p").alias("var"), correlation(F.col("v"), F.col("p")).alias("corr"))  # features times classes rows
    cells = cut(cells)
    main = cells.groupBy("c").agg(F.sum("var").alias("var")).agg(F.max_by("c", F.struct("var", -F.col("c"))).alias("_c"))
    by = cells.crossJoin(F.broadcast(main)).groupBy("f", "_c").agg(F.avg("size").alias("size"), F.max(F.when(F.col("c") == F.col("_c"), F.col("corr"))).alias("corr"))  # main: one row
    gain = F.get(F.array(*[F.lit(float(x)) for x in model.featureImportances.toArray()]), "f")
    out = by.select(F.get(names, "f").alias("feature"), F.col("size"), F.get(labels, "_c").alias("class"), "corr", gain.alias("gain"))
    out = out.join(permuted_accuracy(df, model, columns, classes, seed=seed), "feature")
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "feature"))  # one row a feature
    direction = F.when(F.col("corr") > 0.3, "higher").when(F.col("corr") < -0.3, "lower")
    return out.select("feature", rounded(F.col("size"), 6).alias("importance"), rank.alias("rank"), "class", rounded(F.col("corr")).alias("correlation"), direction.alias("direction"),
        rounded(F.col("gain"), 6).alias("gain"), rounded(F.col("loss")).alias("accuracy_loss"))
