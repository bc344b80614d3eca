"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

One pass measures every whole text (sizes, character classes, repetition, line shape).  Random Fourier features approximate a Gaussian
kernel over the scaled statistics; the normal equations are summed in each partition, then row by row of the matrix in Spark, so that the driver
gets one `features` x `features` matrix however large the corpus is.  The calibration curve is fitted by pool-adjacent-violators to
score bins of labelled rows that the ridge has not seen.  All labelled rows are used, no sample.

Labels are read only from rows whose crc32(doc_id) mod 5 is not 0: of these 1 to 3 train, 4 calibrates.  A score is a function of the text alone.

Defined results: null and empty texts have statistics of zero and get their score like any other; very long texts are measured whole; a doc_id with
several labels takes their mean; null labels are left out; equal scores of the ridge get one calibrated score; without any label every score is 0.5;
repeated rows score alike; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

_CLASS = np.zeros(256, np.int64)
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"#$%&*@^~`=+_\\/<>{}[]", b"|", b" \t\r\x0b\x0c", b"\n"), 1):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 10
N_STATS = 22


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(N_STATS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=11)
    out[:11] = np.sqrt(kinds / len(raw))
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[11] = np.log1p(len(raw)) / 4
    if not n:
        return out
    size = np.fromiter(map(len, words), np.float64, n)
    count = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    out[12:] = (
        np.log1p(n) / 4,
        np.log1p(size.mean()),
        np.log1p(size.std()),
        len(count) / n ** 0.9,
        max(count.values()) / n,
        len(pairs) / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        np.log1p(len(lines)) / 2,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 2,
    )
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


class Fourier:
    """Scaled statistics to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        self.w, self.b = rng.normal(0, np.sqrt(2 * gamma), (len(mean), features - 1)), rng.uniform(0, 2 * np.pi, features - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, N_STATS)


def pool_adjacent(y: list[float], n: list[float]) -> list[float]:
    """The non-decreasing sequence closest to y with weights n."""
    blocks: list[list[float]] = []
    for v, m in zip(y, n, strict=True):
        blocks.append([v, m, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, m2, k2 = blocks.pop()
            v1, m1, k1 = blocks.pop()
            blocks.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, k1 + k2])
    return [v for v, _, k in blocks for _ in range(int(k))]


def fit(measured: DataFrame, labels: DataFrame, *, features: int = 256, gamma: float = 0.03, ridge: float = 1.0, bins: int = 200, seed: int = 7):
    """(model, weights, knots, values) from measured (doc_id, fold, stats) and labels (doc_id, quality); None without labels."""
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    seen = saved(measured.where("fold <> 0").join(y, "doc_id").select("fold", "stats", "y"), "labelled")
    s = seen.where("fold <> 4").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # N_STATS rows
    if not s:
        return None
    model = Fourier(np.array([r["m"] for r in s]), np.array([max(r["s"], 1e-3) for r in s]), features, gamma, seed)

    def sums(batches):
        a = None
        for batch in batches:
            if batch.num_rows:
                z = model(_matrix(batch.column(0)))
                own = z.T @ np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False)])
                a = own if a is None else a + own
        if a is None:  # a partition without labelled rows sends nothing
            return
        yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array(list(a), pa.list_(pa.float64()))], ["i", "row"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])

    kind = "i int, row array<double>"
    rows = seen.where("fold <> 4").select("stats", "y").mapInArrow(sums, kind).repartition(32, "i").mapInArrow(added, kind).orderBy("i").collect()  # one matrix
    a = np.array([r["row"] for r in rows])
    weights = np.linalg.solve(a[:, :features] + ridge * np.eye(features), a[:, features])

    def binned(batches):
        n, t = np.zeros(bins), np.zeros(bins)
        for batch in batches:
            if batch.num_rows:
                at = np.clip((model(_matrix(batch.column(0))) @ weights + 0.5) / 2 * bins, 0, bins - 1).astype(int)
                n += np.bincount(at, minlength=bins)
                t += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(bins), pa.int32()), pa.array(n), pa.array(t)], ["i", "n", "t"])

    hist = seen.where("fold = 4").select("stats", "y").mapInArrow(binned, "i int, n double, t double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n > 0").orderBy("i").collect()  # at most `bins` rows
    knots = np.array([(r["i"] + 0.5) / bins * 2 - 0.5 for r in hist]) if hist else np.array([0.0, 1.0])
    values = np.array(pool_adjacent([(r["t"] + 0.5) / (r["n"] + 1) for r in hist], [r["n"] + 1 for r in hist])) if hist else np.array([0.0, 1.0])
    return model, weights, knots, values


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out and score (0 to 1) for every document."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    measured = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, "doc_id long, stats array<double>").withColumn("fold", fold), "statistics")
    fitted = fit(measured, labels, **options)

    def scored(batches):
        for batch in batches:
            s = np.full(batch.num_rows, 0.5)
            if fitted and batch.num_rows:
                model, weights, knots, values = fitted
                s = np.clip(np.interp(model(_matrix(batch.column(2))) @ weights, knots, values), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["doc_id", "held_out", "score"])

    return measured.select("doc_id", (F.col("fold") == 0).alias("held_out"), "stats").mapInArrow(scored, "doc_id long, held_out boolean, score double")


def op8_quality_model(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
