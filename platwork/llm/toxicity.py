"""Toxicity by class-conditional Kneser-Ney models over words.

Toxic and ordinary texts each have an interpolated Kneser-Ney bigram model: a word after the
word before it, backed off to the pair's chance in both classes together, times how much likelier
the class makes the word itself by how many words it follows there; that is backed off to the
same counts of both classes together, so that a rare expression gets the same chance from either.
(Backed off to the class's words alone, pairs that one class lacks by chance drown the toxic ones.)
The model is a Spark table of packed parts, of word pairs and of words by hash, and grows with the
labelled texts; no task and no driver holds it whole.

Texts are scored in slices of some megabytes. A slice asks for its distinct words and pairs, in
parts by hash; a part of the model meets the questions of all slices in one group and answers in
the order asked; the answers of a slice meet its texts again. A question is asked once a slice
however often a pair occurs, so a common pair weighs no more than a rare one, and the number of
parts grows with the texts and the model, so that groups keep their size.

A text is compared by its length-normalised log ratios, which are a score rather than a ratio of true
likelihoods, as the bent back-off does not sum to one over all words: as a whole and in its most
suspicious stretches of some lengths; a logistic curve over these, fitted on labelled texts that
the counts did not see, makes the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.frames import forget, written

#: Bytes of text in a slice, pairs asked for in a part as far as hashes spread evenly, pairs that a task sums.
SLICE, PART, HELD = 8 << 20, 1 << 22, 1 << 20
#: Words are known by so many bits, pairs by so many more than the number of pairs takes.
WORD_BITS, SPARE = 48, 20
#: Pairs whose chances are worked out at once.
BLOCK = 1 << 16
STRETCHES = (1, 4, 16)
THRESHOLD = 0.3
#: Labelled texts that the curve is fitted on at most; the counts use all others.
CURVE_ROWS = 200_000

WORD = ["a_t", "a_o", "f", "c_t", "c_o", "d_t", "d_o", "d"]
FEATURES = ["mean", *(f"top{n}" for n in STRETCHES), "log_n"]


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts


def words_after(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before (0 at a text's start) and the word itself by 48 bits, and the bounds of texts."""
    w = tx.words(texts, tx.ALNUM, lower=True)
    word = (w.hash >> np.uint64(64 - WORD_BITS)).view(np.int64)
    before = np.zeros(len(word), np.int64)
    before[1:] = word[:-1]
    before[w.first[:-1][w.count > 0]] = 0
    return before, word, w.first


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns in order, and the place of each row among them."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in columns], at


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order and the sums of their values."""
    keys, at = distinct(*keys)
    return keys, [np.bincount(at, v, len(keys[0])).astype(np.int64) for v in values]


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits of a pair of words; parts and questions take the first of them."""
    return tx.mix(tx.mix(h.view(np.uint64)) * np.uint64(3) + w.view(np.uint64))


def first_bits(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).view(np.int64) if bits else np.zeros(len(key), np.int64)


def by_part(part: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts that ascending part numbers name, and where each lies."""
    bounds = np.searchsorted(part, np.arange((1 << bits) + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), slice(int(bounds[p]), int(bounds[p + 1]))


def part_bits(size: int) -> int:
    """How many bits number the parts that the word pairs of so many bytes of text are dealt to."""
    return max(0, (size // 6 // PART).bit_length())


def count_grams(labelled: DataFrame, bits: int) -> DataFrame:
    """The word pairs of `labelled` (text, toxic) with the numbers of toxic and of ordinary texts that hold
    them, summed and packed: rows with part, kind and rows. Kind 0: h, w, t, o of a part of the pairs. Kind 1:
    a part of the words, with the sums over some of the pairs in the order of `WORD`.

    A text counts once for each of its pairs, or one that repeats a line would set the tone.
    Tasks sum before the shuffle as far as `HELD` rows go.
    """
    schema = "part int, kind int, rows binary"

    def rows_of(p: list[int], kind: int, rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array([kind] * len(p), pa.int32()), pa.array(rows, pa.binary())], ["part", "kind", "rows"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def merged() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*held)]
            keys, counts = summed(columns[:2], columns[2:])
            return [*keys, *counts]

        def dealt(h: np.ndarray, w: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            part = first_bits(pair_key(h, w), bits)
            order = np.argsort(part, kind="stable")
            columns = [c[order] for c in (h, w, *counts)]
            for p, at in by_part(part[order], bits):
                h, *others = (c[at] for c in columns)
                yield rows_of([p], 0, [tx.packed(np.diff(h, prepend=0), *others)])

        for part in tx.slices(batches):
            h, w, bounds = words_after(part.column("text"))
            (h, w, doc), _ = distinct(h, w, np.repeat(np.arange(part.num_rows), np.diff(bounds)))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
            (h, w), counts = summed([h, w], [toxic, 1 - toxic])
            held.append([h, w, *counts])
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield from dealt(*held.pop())
        if held:
            yield from dealt(*merged())

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        h, w, t, o = pairs_of(group.column("rows").to_pylist())
        out = [rows_of([key[0].as_py()], 0, [tx.packed(np.diff(h, prepend=0), w, t, o)])]
        one = np.ones(len(h), np.int64)
        (after,), a = summed([w], [t > 0, o > 0, one])
        (ahead,), c = summed([h], [t, o, t > 0, o > 0, one])
        none_a, none_c = np.zeros(len(after), np.int64), np.zeros(len(ahead), np.int64)
        columns = [*(np.concatenate([x, none_c]) for x in a), *(np.concatenate([none_a, x]) for x in c)]
        (word,), sums = summed([np.concatenate([after, ahead])], columns)
        for p, at in by_part(word >> (WORD_BITS - bits), bits):
            out.append(rows_of([p], 1, [tx.packed(np.diff(word[at], prepend=0), *(x[at] for x in sums))]))
        return pa.Table.from_batches(out)

    return (
        labelled.select("text", "toxic").mapInArrow(run, schema).groupBy("part").applyInArrow(joined, schema)
    )


def pairs_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """h, w, t, o of packed pairs, each pair once, in order."""
    held = [tx.unpacked(b, 4) for b in blobs]
    if not held:
        return (np.zeros(0, np.int64),) * 4
    h, w, t, o = (np.concatenate(c) for c in zip(*([np.cumsum(x[0]), *x[1:]] for x in held)))
    (h, w), (t, o) = summed([h, w], [t, o])
    return h, w, t, o


def words_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of packed sums, each once, in order, and a row of the sums of each."""
    held = [tx.unpacked(b, 1 + len(WORD)) for b in blobs]
    if not held:
        return np.zeros(0, np.int64), np.zeros((0, len(WORD)), np.int64)
    columns = [np.concatenate(c) for c in zip(*([np.cumsum(x[0]), *x[1:]] for x in held))]
    (word,), sums = summed(columns[:1], columns[1:])
    return word, np.column_stack(sums)


#: What a part of the model adds to its totals.
TOTALS = ["n_pairs", "t1", "t2", "o1", "o2", "s1", "s2", "n_words", *(f"{n}_{c}" for c in WORD[:3] for n in ("one", "two", "sum", "some"))]


class Model:
    """Pairs (h, w; toxic and ordinary texts) and words (words it follows by class and in all; as the word
    before: texts by class, words after it by class and in all), packed in parts by hash and written, and
    the few totals of a Kneser-Ney model."""

    def __init__(self, labelled: DataFrame, bits: int):
        self.bits = bits
        counted = written(count_grams(labelled, bits), "toxic-counts", tidy=True)

        def merged(key: tuple, group: pa.Table) -> pa.Table:
            kind = group.column("kind").to_numpy()
            pairs, sums = ([b for b, k in zip(group.column("rows").to_pylist(), kind) if k == i] for i in (0, 1))
            _, _, t, o = pairs_of(pairs)
            word, of = words_of(sums)
            x = [len(t), *((c == i).sum() for c in (t, o, t + o) for i in (1, 2)), len(word)]
            for i in range(3):
                c = of[:, i]
                x += [(c == 1).sum(), (c == 2).sum(), c.sum(), (c > 0).sum()]
            return pa.table(
                {
                    "part": [key[0].as_py()], "pairs": pa.array([pairs[0] if pairs else None], pa.binary()),
                    "words": pa.array([tx.packed(np.diff(word, prepend=0), *of.T)], pa.binary()),
                    **{c: pa.array([int(v)], pa.int64()) for c, v in zip(TOTALS, x)},
                }
            ).cast(pa.schema([("part", pa.int32()), ("pairs", pa.binary()), ("words", pa.binary()), *((c, pa.int64()) for c in TOTALS)]))

        self.parts = written(
            counted.groupBy("part").applyInArrow(merged, "part int, pairs binary, words binary, " + ", ".join(f"{c} long" for c in TOTALS)),
            "toxic-model", tidy=True,
        )
        forget(counted)
        n = {k: v or 0 for k, v in self.parts.agg(*(F.sum(c).alias(c) for c in TOTALS)).first().asDict().items()}

        def discount(once: int, twice: int) -> float:
            return once / (once + 2 * twice) if once else 0.5

        self.discount = [discount(n[f"{c}1"], n[f"{c}2"]) for c in "tos"]
        self.follow = [(discount(n[f"one_{c}"], n[f"two_{c}"]), n[f"sum_{c}"], n[f"some_{c}"]) for c in WORD[:2]]
        self.total, self.known = n["sum_f"], n["some_f"]
        #: A question names a pair by so many bits: one unknown pair in 2^`SPARE` is taken for a known one.
        self.key_bits = min(63, max(n["n_pairs"].bit_length() + SPARE, bits))

    def chances(self) -> Callable:
        """A function of pair counts and of both words' counts to log p(toxic) - log p(ordinary)."""
        discounts, follow, total, known = self.discount, self.follow, self.total, self.known

        def ratio(pair: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
            shared = (word[:, 2] + 1) / (total + known + 1)
            d, c = discounts[2], before[:, 3] + before[:, 4]
            joint = (np.maximum(pair[:, 0] + pair[:, 1] - d, 0) + d * before[:, 7] * shared) / np.maximum(c, 1)
            joint = np.where(c > 0, joint, shared)
            logs = []
            for i in range(2):
                d, n, some = follow[i]
                p = (np.maximum(word[:, i] - d, 0) + d * some * shared) / n if n else shared
                c, d = before[:, 3 + i], discounts[i]
                back = joint * p / shared
                own = (np.maximum(pair[:, i] - d, 0) + d * before[:, 5 + i] * back) / np.maximum(c, 1)
                logs.append(np.log(np.where(c > 0, own, back)))
            return logs[0] - logs[1]

        return ratio


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a task's rows with their numbers; the same whenever the task runs over the same rows."""
    task, n = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0
    for part in tx.slices(batches, SLICE):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if size >= SLICE:
            yield (task << 32) + n, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, n = [], 0, n + 1
    if held:
        yield (task << 32) + n, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def asked(texts: pa.Array, key_bits: int):
    """What a slice asks: its words, and its pairs' keys, both ascending; and its distinct pairs' words and
    places among the keys, each occurrence's pair, and the bounds of texts."""
    h, w, bounds = words_after(texts)
    key, first, at = np.unique(pair_key(h, w), return_index=True, return_inverse=True)
    h, w = h[first], w[first]
    key, of_key = np.unique(first_bits(key, key_bits), return_inverse=True)
    return np.unique(np.concatenate([h, w])), key, h, w, of_key, at, bounds


def looked_up(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted keys there are, and the place of each of these; both ascend."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    met = np.flatnonzero(keys[at] == want)
    return met, at[met]


def measures(docs: DataFrame, model: Model, keep: list[str], name: str = "features") -> DataFrame:
    """The columns in `keep` and, as an array `name`, the length-normalised comparisons of every text
    (`FEATURES`); zeros without words.

    `docs` is read twice and must give the same rows to the same tasks, as files do; a slice that
    differs is refused (TEXTS_DIFFER).
    """
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    bits, key_bits = model.bits, model.key_bits
    ratio = model.chances()

    def mark(*numbers: np.ndarray) -> int:
        return int(np.bitwise_xor.reduce(np.concatenate(numbers)))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part in cut(batches):
            word, key, *_ = asked(part.column("text"), key_bits)
            of_word, of_pair = (dict(by_part(x >> (width - bits), bits)) for x, width in ((word, WORD_BITS), (key, key_bits)))
            for p in sorted(of_word.keys() | of_pair.keys()):
                x = [c[at.get(p, slice(0, 0))] for c, at in ((word, of_word), (key, of_pair))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([n]), *(pa.array([tx.packed(np.diff(c, prepend=0))]) for c in x)],
                    ["part", "slice", "words", "pairs"],
                )

    def answer(_, known: pa.Table, questions: pa.Table) -> pa.Table:
        h, w, t, o = pairs_of([b for b in known.column("pairs").to_pylist() if b is not None])
        keys, first = np.unique(first_bits(pair_key(h, w), key_bits), return_index=True)
        t, o = t[first], o[first]
        of, values = words_of(known.column("words").to_pylist())
        out: list[list] = [[], [], [], [], []]
        for q in questions.to_batches(max_chunksize=1):
            word, pair = (np.cumsum(tx.unpacked(q.column(c)[0].as_py(), 1)[0]) for c in ("words", "pairs"))
            i, at = looked_up(of, word)
            j, to = looked_up(keys, pair)
            row = (
                q.column("slice")[0].as_py(), q.column("part")[0].as_py(), tx.packed(np.diff(i, prepend=0), *values[at].T),
                tx.packed(np.diff(j, prepend=0), t[to], o[to]), mark(word, pair),
            )
            for c, v in zip(out, row):
                c.append(v)
        return pa.table(
            [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))],
            ["slice", "part", "words", "pairs", "mark"],
        )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part in cut(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sink.getvalue().to_pybytes()])], ["slice", "rows"])

    def score(_, slices: pa.Table, answers: pa.Table) -> pa.Table:
        (blob,) = slices.column("rows").to_pylist()
        part = pa.ipc.open_stream(blob).read_all().combine_chunks()
        word, key, h, w, of_key, at, bounds = asked(part.column("text"), key_bits)
        of_word, of_pair = np.zeros((len(word), len(WORD))), np.zeros((len(key), 2))
        word_at, pair_at = (dict(by_part(x >> (width - bits), bits)) for x, width in ((word, WORD_BITS), (key, key_bits)))
        left = len(word) + len(key)
        for batch in answers.to_batches(max_chunksize=1):
            (x,) = batch.to_pylist()
            i, j = (where.get(x["part"], slice(0, 0)) for where in (word_at, pair_at))
            if mark(word[i], key[j]) != x["mark"]:
                raise RuntimeError("TEXTS_DIFFER: the texts differ between two readings")
            place, *values = tx.unpacked(x["words"], 1 + len(WORD))
            of_word[i.start + np.cumsum(place)] = np.column_stack(values)
            place, t, o = tx.unpacked(x["pairs"], 3)
            of_pair[j.start + np.cumsum(place)] = np.column_stack([t, o])
            left -= i.stop - i.start + j.stop - j.start
        if left:
            raise RuntimeError("TEXTS_DIFFER: the texts differ between two readings")
        word_of, before_of = np.searchsorted(word, w), np.searchsorted(word, h)
        table = np.empty(len(w))
        for a in range(0, len(w), BLOCK):
            b = slice(a, a + BLOCK)
            table[b] = ratio(of_pair[of_key[b]], of_word[word_of[b]], of_word[before_of[b]])
        total = np.zeros(len(at) + 1)
        np.cumsum(table[at], out=total[1:])
        n = np.diff(bounds)
        some = np.flatnonzero(n > 0)
        columns = [(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)]
        for size in STRETCHES:
            # Every stretch ends at its text's end at the latest and is divided by its full length.
            end = np.minimum(np.arange(len(at)) + size, np.repeat(bounds[1:], n))
            stretch = (total[end] - total[:-1]) / size
            top = np.zeros(len(n))
            if len(some):
                top[some] = np.maximum.reduceat(stretch, bounds[:-1][some])
            columns.append(top)
        columns.append(np.log1p(n))
        features = pa.array(list(np.column_stack(columns)), pa.list_(pa.float64()))
        return pa.table([*(part.column(c) for c in keep), features], [*keep, name])

    questions = rows.mapInArrow(ask, "part int, slice long, words binary, pairs binary")
    answers = written(
        model.parts.select("part", "pairs", "words").groupBy("part").cogroup(questions.groupBy("part"))
        .applyInArrow(answer, "slice long, part int, words binary, pairs binary, mark long"),
        "toxic-answers", tidy=True,
    )
    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return (
        rows.mapInArrow(pack, "slice long, rows binary").groupBy("slice").cogroup(answers.groupBy("slice"))
        .applyInArrow(score, f"{kept}`{name}` array<double>")
    )


def curve(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: centres, scales, weights (the last: the constant)."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1)
    z = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.diag([strength] * (len(w) - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


class Fit:
    """Texts measured by a model learned from labelled ones, and the chance that it gives a text.

    Labels (doc_id, toxic) are used of ids whose crc32 leaves a remainder by `parts` other than
    `held_out`: one in `curve_part` of them for the curve, the others for the counts. Null
    labels and ids are left out, repeated ones count each. Without labels of both kinds the
    chance is the share of toxic ones (0 without any) and `fitted` is false.

    `rows` are the columns in `keep` (doc_id among them) and the measures of every row of `docs`; every
    text is measured once, and the curve is fitted on the measures of the labelled ones.
    """

    def __init__(
        self, docs: DataFrame, labels: DataFrame, keep: list[str], parts: int = 4, held_out: int = 2, curve_part: int = 5
    ):
        known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(
            F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")
        )
        self.held_out = F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False))
        known = known.where(~self.held_out)
        for_curve = F.expr(f"crc32(cast(doc_id AS string)) DIV {parts} % {curve_part} = 0")
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # Labels grow with the corpus, so they are never broadcast.
        model = Model(keyed.join(known.where(~for_curve).hint("merge"), "doc_id"), part_bits(size))
        name = "features"
        while name in {c.lower() for c in docs.columns}:
            name += "_"
        self.rows = written(measures(docs, model, keep, name), "toxic-measures", tidy=True)
        features = self.rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("x"))
        some = features.join(known.where(for_curve).hint("merge"), "doc_id")
        n = some.count()
        if n > CURVE_ROWS:
            some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * CURVE_ROWS / n))
        found = some.select("x", "toxic").toPandas()
        y = found["toxic"].to_numpy(float)
        self.fitted = len(set(y)) == 2
        if not self.fitted:
            self.chance = F.lit(float(y.mean()) if len(y) else 0.0)
            return
        centre, scale, w = curve(np.array(found["x"].to_list(), float), y)
        total = F.lit(float(w[-1]))
        for i, (c, s, x) in enumerate(zip(centre, scale, w)):
            z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name)[i] - float(c)) / float(s)))
            total = total + z * float(x)
        self.chance = 1 / (1 + F.exp(-total))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per row of `docs`.

    Null texts score as empty ones, texts without words by their length alone; a long text is scored
    whole, in one task. A null id is held out of nothing and never learned from. Repeated rows get a row
    each. An empty table gives no rows; other columns are not looked at.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fit = Fit(keyed, labels, ["doc_id"])
    return fit.rows.select("doc_id", fit.held_out.alias("held_out"), fit.chance.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns, whatever these are called; all
    if nothing can be learned. Of repeated rows all stay or all go."""
    fit = Fit(docs, labels, docs.columns)
    return fit.rows.where(fit.chance < threshold).select(*docs.columns) if fit.fitted else docs
