"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

Every text is described by a few statistics of its characters, words and repetitions. Random
cosines of the standardised statistics approximate a Gaussian kernel, so ridge regression on
them is kernel regression with a model of fixed size. Each task sums its own normal equations
and the sums are added up in Spark; only they reach the driver. Learned labels not used for the
equations calibrate the result: pooled adjacent violators over classes of the raw score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.frames import written
from platwork.llm.repetition import measure
from platwork.llm.toxicity import fold

COSINES, SEED = 256, 7
RIDGE = 1e-3
#: Classes of the raw score from LOW to HIGH that the calibration counts labels in.
CLASSES, LOW, HIGH = 512, -0.5, 1.5
THRESHOLD = 0.3

_SHARES = {
    "upper": np.arange(0x41, 0x5B), "digit": np.arange(0x30, 0x3A), "blank": np.array([0x20, 0x09, 0x0D]),
    "feed": np.array([0x0A]), "stop": np.array(list(b".,;:?")), "shout": np.array(list(b"!")),
    "symbol": np.array(list(b"#*$%&<>@^~_=+/\\")), "bar": np.array(list(b"|")), "quote": np.array(list(b"\"'()[]{}")),
    "beyond": np.arange(0x80, 0x100),
}
STATISTICS = [
    *_SHARES, "log_words", "word_length", "longest_word", "different", "twice", "log_lines", "line_words",
    "dup_lines", "dup_ngrams", "repeat_words", "entropy",
]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text; zeros where there is nothing to measure."""
    w = tx.words(texts)
    m = measure(texts)
    size = np.maximum(np.diff(w.offsets), 1)
    n = np.maximum(w.count, 1)
    columns = []
    for members in _SHARES.values():
        inside = np.zeros(256, bool)
        inside[members] = True
        columns.append(tx.sums_by_text(inside[w.data], w.offsets) / size)
    length = w.end - w.start
    longest = np.zeros(len(n))
    some = w.count > 0
    if some.any():
        longest[some] = np.maximum.reduceat(length, w.first[:-1][some])
    key = tx.mix(w.hash + w.doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    twice = tx.repeated(key)
    order = np.sort(key[twice])
    kinds = np.bincount(w.doc[~twice], minlength=len(n)).astype(float)
    if len(order):
        first = np.unique(key[twice], return_index=True)[1]
        kinds += np.bincount(w.doc[np.flatnonzero(twice)[first]], minlength=len(n))
    feeds = tx.sums_by_text(w.data == 0x0A, w.offsets)
    # Entropy of the bytes, over sixteen classes of them.
    high = (np.repeat(np.arange(len(n)), np.diff(w.offsets)) << 4) | (w.data >> 4)
    share = np.bincount(high, minlength=16 * len(n)).reshape(-1, 16) / size[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    columns += [
        np.log1p(w.count), tx.sums_by_text(length, w.first) / n, np.log1p(longest), kinds / n,
        tx.sums_by_text(twice, w.first) / n, np.log1p(feeds), np.log1p(w.count / (feeds + 1)),
        m["dup_line_share"], m["dup_ngram_share"], m["n_repeat_words"] / n, entropy,
    ]
    return np.column_stack(columns)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c) for c in x.T)], ["doc_id", *STATISTICS]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)
    )


class Cosines:
    """The random features: centres and scales of the statistics, directions, phases."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, n: int = COSINES, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.centre, self.scale = centre, np.where(scale > 0, scale, 1)
        self.direction = random.normal(size=(len(centre), n)) / np.sqrt(len(centre))
        self.phase = random.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6) @ self.direction + self.phase
        return np.column_stack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS])


def normal_equations(rows: DataFrame, features: Cosines) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over rows with the statistics and y; the sums of tasks are added by row."""
    n = len(features.phase) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            z = features(_matrix(batch))
            total += z.T @ np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(total))], ["i", "sums"])

    def added(key: tuple, part: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for c in part.column("sums").chunks for x in c], axis=0)
        return pa.table({"i": pa.array([key[0].as_py()]), "sums": pa.array([total])})

    partial = rows.select(*STATISTICS, "y").mapInArrow(run, "i long, sums array<double>")
    found = partial.groupBy("i").applyInArrow(added, "i long, sums array<double>").toArrow().sort_by("i")
    total = np.array(found.column("sums").to_pylist()).reshape(-1, n + 1)
    return (total[:, :-1], total[:, -1]) if len(total) else (np.eye(n), np.zeros(n))


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The ascending shares closest to ones / n, by pooling neighbours out of order."""
    blocks: list[list[float]] = []
    for weight, hits in zip(n.tolist(), ones.tolist()):
        blocks.append([weight, hits, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), h / w) for w, h, k in blocks])


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, calibrated: int = 4) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per row of `docs`.

    Labels (doc_id, quality) are used of ids whose crc32 leaves a remainder by `parts` other
    than `held_out`: the remainder `calibrated` for the calibration, the rest for the equations.
    Null texts score as empty ones. Null labels are left out, repeated ones count each. A null
    id is held out of nothing and never learned from. Without labels for one of the two steps
    every score is the share of ones among those there are (0 without any).
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")
    )
    part = fold(F.col("doc_id"), parts)
    table = written(described(docs), "quality-statistics")
    learned = table.join(known, "doc_id").where(part != held_out)
    equations, calibration = learned.where(part != calibrated), learned.where(part == calibrated)
    moments = equations.agg(
        *(F.avg(c).alias(f"m_{c}") for c in STATISTICS), *(F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS), F.count("*").alias("n")
    ).first()
    counts = {}
    if moments["n"]:
        features = Cosines(*(np.array([moments[f"{k}_{c}"] for c in STATISTICS]) for k in "ms"))
        a, b = normal_equations(equations, features)
        weights = np.linalg.solve(a + RIDGE * moments["n"] * np.diag([*[1.0] * (len(b) - 1), 0]) + 1e-9 * np.eye(len(b)), b)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = features(_matrix(batch)) @ weights
                kind = np.clip((raw - LOW) / (HIGH - LOW) * CLASSES, 0, CLASSES - 1).astype(np.int64)
                rest = [c for c in batch.schema.names if c not in STATISTICS]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(kind)], [*rest, "kind"])

        rows = calibration.select("doc_id", "y", *STATISTICS).mapInArrow(run, "doc_id long, y double, kind long")
        counts = {r["kind"]: (r["n"], r["ones"]) for r in rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}
        table = table.mapInArrow(run, "doc_id long, kind long")
    if counts:
        seen = np.array(sorted(counts))
        shares = isotonic(*(np.array([counts[k][i] for k in seen.tolist()], float) for i in (0, 1)))
        # Between classes with labels the share runs evenly; no score is surer than its labels allow.
        n = sum(c for c, _ in counts.values())
        curve = np.clip(np.interp(np.arange(CLASSES), seen, shares), 1 / (n + 2), 1 - 1 / (n + 2))
        score = F.get(F.array(*map(F.lit, curve.tolist())), F.col("kind"))
    else:
        score = F.lit(float(learned.agg(F.avg("y")).first()[0] or 0.0))
    return table.select(
        "doc_id", F.coalesce(part == held_out, F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
