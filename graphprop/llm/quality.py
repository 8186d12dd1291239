"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.store import Scratch

STATISTICS = (
    "log_words", "log_chars", "word_length", "upper", "digit", "blank", "symbol", "bang", "pipe", "beyond_ascii", "closing",
    "log_lines", "words_per_line", "distinct_words", "repeats_last_word", "repeats_second_last", "commonest_word", "repeated_lines", "symbol_ends", "short_words",
)

_ROW_END = np.zeros(256, bool)
_ROW_END[10] = True


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_UPPER, _DIGIT, _BEYOND = _class((65, 90)), _class((48, 57)), _class((128, 255))
_SYMBOL = _class((35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
_CLOSE = _class((46, 46), (63, 63))


@dataclass(frozen=True)
class Quality:
    features: int = 256
    kernel_width: float = 4.0
    ridge: float = 1e-3
    bins: int = 1000
    threshold: float = 0.3
    seed: int = 7


def _sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[of[1:]] - total[of[:-1]]).astype(float)


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: distinct values, and the count of the commonest."""
    n, most = np.zeros(len(of) - 1), np.zeros(len(of) - 1)
    for k in range(len(of) - 1):
        if of[k] < of[k + 1]:
            s = np.sort(h[of[k] : of[k + 1]])
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            n[k], most[k] = len(edge) - 1, np.diff(edge).max()
    return n, most


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``x``, the statistics named in STATISTICS of the whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = tx.utf8(batch.column(1))
            ids, xs = [], []
            for lo, hi in tx.blocks(offsets):
                raw, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = tx.words(raw, off)
                h = tx.hashes(tx.folded(raw), starts, ends)
                ls, le, lof = tx.words(raw, off, _ROW_END)
                lh = tx.hashes(raw, ls, le)
                n_bytes, n_words, n_lines = np.maximum(np.diff(off), 1), np.maximum(np.diff(of), 1), np.maximum(np.diff(lof), 1)
                row = np.repeat(np.arange(hi - lo), np.diff(of))
                back = lambda k: np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (row[k:] == row[:-k])]) if len(h) else np.zeros(0, bool)
                kinds, most = _distinct(h, of)
                line_kinds, _ = _distinct(lh, lof)
                share = lambda lut: _sums(lut[raw], off) / n_bytes
                last = raw[ends - 1] if len(ends) else raw
                x = np.stack(
                    [
                        np.log1p(np.diff(of)), np.log1p(np.diff(off)), np.minimum(_sums(ends - starts, of) / n_words, 40),
                        share(_UPPER), share(_DIGIT), share(tx.BLANKS), share(_SYMBOL), share(_class((33, 33))), share(_class((124, 124))), share(_BEYOND), share(_CLOSE),
                        np.log1p(np.diff(lof)), np.log1p(n_words / n_lines), kinds / n_words, _sums(back(1), of) / n_words, _sums(back(2), of) / n_words,
                        most / n_words, 1 - line_kinds / n_lines, _sums(_SYMBOL[last], of) / n_words, _sums(ends - starts <= 2, of) / n_words,
                    ],
                    1,
                )
                ids.append(batch.column(0).slice(lo, hi - lo))
                xs += list(x.astype(np.float32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(xs, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, x array<float>")


class FourierMap:
    """``sqrt(2/D) cos(Wx + b)``: its inner products approximate a Gaussian kernel on standardised statistics."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, cfg: Quality):
        rng = np.random.default_rng(cfg.seed)
        self.mean, self.sd, self.d = mean, np.where(sd > 1e-6, sd, 1), cfg.features
        self.w = rng.normal(size=(len(mean), cfg.features)) / cfg.kernel_width
        self.b = rng.uniform(0, 2 * np.pi, cfg.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        angle = np.tile(self.b, (len(x), 1))
        for k, row in enumerate(self.w):  # in a fixed order: a matrix product's last bits depend on the batch
            angle += z[:, k, None] * row
        return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / self.d) * np.cos(angle)], 1)


def _rows(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float)


def ridge_weights(train: DataFrame, phi: FourierMap, cfg: Quality) -> np.ndarray:
    """Solve the normal equations, summed within partitions and then by entry."""
    d = cfg.features + 1

    def run(batches):
        total = np.zeros((d, d + 1))
        for batch in batches:
            if len(batch):
                f = phi(_rows(batch, 0))
                total[:, :d] += f.T @ f
                total[:, d] += f.T @ batch.column(1).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    summed = train.select("x", "y").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    a = np.zeros((d, d + 1))
    a[summed["i"], summed["j"]] = summed["v"]
    n = max(a[0, 0], 1)
    return np.linalg.solve(a[:, :d] / n + cfg.ridge * np.eye(d), a[:, d] / n)


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the points (x, y) of the non-decreasing fit."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, mean, weight, strict=True):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def quality(docs: DataFrame, labels: DataFrame, cfg: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality) is learnt from only where crc32(doc_id) mod 5
    is not 0: three quarters of these rows fit the ridge scores, the others the
    calibration. Rows with a null id or label teach nothing; of labels that
    disagree on one id the larger counts. Null and empty texts have all-zero
    statistics and a score like any text. A null id counts as not held out.
    Repeated rows are scored each, equal texts equally. Without labels every
    score is 0.5; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    table = scratch.keep(statistics(docs, id_col, text_col), "statistics")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y")).where(fold != 0)
    train = scratch.keep(table.join(y, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrates")), "train")
    k = len(STATISTICS)
    stat = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i].cast("double")).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = table.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "x")
    if not stat["n"]:
        return out.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(0.5 >= cfg.threshold)).alias("predicted"))
    phi = FourierMap(np.array([stat[f"m{i}"] for i in range(k)]), np.array([stat[f"s{i}"] for i in range(k)]), cfg)
    w = ridge_weights(train.where(~F.col("calibrates")), phi, cfg)

    def raw(frame: DataFrame, *keep: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                z = np.add.reduce(phi(_rows(batch, len(keep))) * w, 1) if len(batch) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.float64())], [*keep, "z"])

        kinds = dict(frame.dtypes)
        return frame.select(*keep, "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", z double")

    step = 2.0 / cfg.bins
    binned = raw(train.where("calibrates"), "y").groupBy(F.floor(F.greatest(F.least(F.col("z"), F.lit(1.5)), F.lit(-0.5)) / step).alias("b")).agg(F.avg("z").alias("z"), F.avg(F.col("y").cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).orderBy("z").collect()
    if binned:
        xs, ys = isotonic(np.array([r.z for r in binned]), np.array([r.y for r in binned]), np.array([float(r.n) for r in binned]))
    else:
        xs, ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def calibrated(batches):
        for batch in batches:
            z = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(0.98 * np.interp(z, xs, ys) + 0.02 * np.clip(z, 0, 1), 0, 1))], ["doc_id", "held_out", "score"])

    scored = raw(out, "doc_id", "held_out").mapInArrow(calibrated, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))
