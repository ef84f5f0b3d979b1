"""Fingerprints of documents by locally consistent parsing.

A text's bytes are named, and the sequence of names is parsed level by level: a run of equal names
becomes one name, deterministic coin tossing (the lowest bit in which a name differs from the one
before it, with that bit's value, four times over) leaves labels 0 to 5 of which neighbours differ,
and a phrase begins wherever a label exceeds both its neighbours. A phrase's name is a hash of the
names in it; phrases are the symbols of the next level. Whether a phrase begins somewhere depends on
five symbols before and one behind it alone, so equal substrings are cut into equal phrases but for
their rims, at whatever offset they lie, and share the names inside.

A level's phrases hold about three times as many characters as those below. The fingerprint keeps
the smallest hashes of a text's distinct names from level `BASE` up, and of the name of the whole
text; likeness is the share of common names that two such samples show (twice those in common by
the sum of both). Texts of few phrases are compared by all of them.

`fingerprints` needs no shuffle. `with_next` compares every text with the one that follows it by id,
and with a version of itself that ends in that text's beginning: rows are dealt by ranges of id, a
task holds one row back until its successor comes, and only the first and last rows of tasks meet
in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.frames import written

#: The lowest level whose phrases count, of some 9 bytes (level 1: some 3).
BASE = 2
#: Names kept of a text, each as 32 bits.
KEPT = 64

_SYMBOL = tx.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
_RUN = np.uint64(0xA0761D6478BD642F)


def _tossed_table() -> np.ndarray:
    """The coin of each pair of bytes: twice the lowest bit they differ in, plus its value in the second."""
    a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    x = a ^ b
    low = np.bitwise_count((x & -x) - 1) * (x > 0)
    return (2 * low + ((b >> low) & 1)).astype(np.uint8)


_TOSSED = _tossed_table()


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 of symbols (bytes or names); neighbours in one text have different ones.
    `first`: places of texts' first symbols."""
    if symbols.dtype == np.uint8:
        label = symbols
    else:
        x = symbols[1:] ^ symbols[:-1]
        low = np.zeros(len(symbols), np.uint64)
        low[1:] = np.minimum(np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)), 63)
        low[first] = 0
        label = ((low << np.uint64(1)) | ((symbols >> low) & np.uint64(1))).astype(np.uint8)
    for _ in range(4 if symbols.dtype == np.uint8 else 3):
        new = np.empty_like(label)
        new[1:] = _TOSSED[label[:-1], label[1:]]
        new[first] = label[first] & 1
        label = new
    return label


def _level(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names and bounds of the phrases of texts whose symbols (bytes or names) are given; no text is empty.

    Runs next to each other are of different symbols, so these are what the coins are tossed for."""
    first = bounds[:-1]
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(symbols)))
    symbols = symbols[at]
    bounds = np.searchsorted(at, bounds)
    first = bounds[:-1]
    label = _labels(symbols, first)
    if symbols.dtype == np.uint8:
        symbols = _SYMBOL[symbols]
    many = np.flatnonzero(run > 1)
    symbols[many] = tx.mix(symbols[many] * _RUN + run[many].astype(np.uint64))
    begin = np.zeros(len(symbols), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[bounds[1:] - 1] = False
    begin[first] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(symbols)))
    offset = np.arange(len(symbols)) - np.repeat(start, size)
    name = np.add.reduceat(symbols * _POWER[np.minimum(offset, 63)], start)
    return tx.mix(name + size.astype(np.uint64)), np.searchsorted(start, bounds)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and name of every phrase that counts, of texts given as bytes and offsets."""
    texts = np.flatnonzero(np.diff(offsets) > 0)
    bounds = np.append(offsets[texts], offsets[-1])
    symbols, level = data, 0
    owners, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while len(texts):
        symbols, bounds = _level(symbols, bounds)
        level += 1
        size = np.diff(bounds)
        whole = size == 1
        counts = np.full(len(texts), level >= BASE) | whole
        owners.append(np.repeat(texts[counts], size[counts]))
        names.append(symbols[np.repeat(counts, size)])
        symbols = symbols[np.repeat(~whole, size)]
        texts, size = texts[~whole], size[~whole]
        bounds = np.concatenate([[0], np.cumsum(size)])
    return np.concatenate(owners), np.concatenate(names)


class Sketches:
    """Of each text the smallest hashes of its names, ascending: values and bounds, and whether these are all."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        owner, name = phrases(data, offsets)
        value = (tx.mix(name ^ _RUN) >> np.uint64(32)).astype(np.int64)
        key = np.sort((owner << 32) | value)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        owner, value = key >> 32, key & 0xFFFFFFFF
        n = len(offsets) - 1
        bounds = np.searchsorted(owner, np.arange(n + 1))
        kept = np.arange(len(owner)) - bounds[owner] < KEPT
        self.owner, self.value = owner[kept], value[kept]
        self.bounds = np.searchsorted(self.owner, np.arange(n + 1))

    def packed(self) -> list[bytes]:
        raw = self.value.astype(">u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(self.bounds.tolist(), self.bounds[1:].tolist())]


def likeness(value: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of texts the likeness by their sketches: 1 for equal ones, 0 for a text without any and one with."""
    n = np.diff(bounds)
    rows = [tx.ranges(bounds[side], bounds[side + 1]) for side in (left, right)]
    pair = np.concatenate([np.repeat(np.arange(len(side)), n[side]) for side in (left, right)])
    key = np.sort((pair << 32) | value[np.concatenate(rows)])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    both = np.diff(np.append(at, len(key))) > 1
    pair = key[at] >> 32
    start = np.searchsorted(pair, np.arange(len(left) + 1))
    # Beyond the last value of a full sketch the other one may hold names that it had to leave out.
    among = np.arange(len(at)) - start[pair] < np.maximum(np.maximum(n[left], n[right]), 1)[pair]
    shared = np.bincount(pair[among & both], minlength=len(left))
    joint = np.bincount(pair[among], minlength=len(left))
    full = np.maximum(n[left], n[right]) >= KEPT
    if (~full).any():
        all_shared, all_joint = np.bincount(pair[both], minlength=len(left)), np.diff(start)
        shared, joint = np.where(full, shared, all_shared), np.where(full, joint, all_joint)
    return np.where(joint > 0, 2 * shared / np.maximum(joint + shared, 1), 1.0)


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all) of every row with its `fingerprint` (binary, 4 bytes a name).

    Equal texts have equal fingerprints; null and empty texts have an empty one. Whole texts are
    parsed, a very long one in one piece; repeated rows each get theirs. An input column named
    fingerprint is replaced; no rows give none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            found = Sketches(*tx.buffers(part.column("text"))).packed()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(found, pa.binary())], [*keep, "fingerprint"]
            )

    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kept, "fingerprint binary"]))


def edited(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text but the last with its last quarter replaced by as much of the next one, and the
    texts' lengths, all in code points."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(starts, offsets)
    starts = np.append(starts, len(data))
    n = np.diff(first)
    quarter = n[:-1] // 4
    low, high = offsets[:-2], starts[first[1:-1] - quarter]
    next_low, next_high = offsets[1:-1], starts[first[1:-1] + np.minimum(quarter, n[1:])]
    size = np.column_stack([high - low, next_high - next_low])
    at = tx.ranges(np.column_stack([low, next_low]).reshape(-1), np.column_stack([high, next_high]).reshape(-1))
    return data[at], np.concatenate([[0], np.cumsum(size.sum(axis=1))]), n


COMPARED = {
    "n_chars": "long", "edited_sha256": "string", "fingerprint": "binary", "edited_fingerprint": "binary",
    "near_edited": "double", "near_next": "double",
}


def compared(texts: pa.Array) -> list[pa.Array]:
    """The columns `COMPARED` of every text but the last, each with its successor."""
    data, offsets = tx.buffers(texts)
    new, new_offsets, n = edited(data, offsets)
    m = len(offsets) - 2
    sketch = Sketches(np.concatenate([data, new]), np.concatenate([offsets, new_offsets[1:] + len(data)]))
    packed, this = sketch.packed(), np.arange(m)
    raw = new.tobytes()
    digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(new_offsets.tolist(), new_offsets[1:].tolist())]
    near = [likeness(sketch.value, sketch.bounds, this, other) for other in (this + m + 1, this + 1)]
    return [
        pa.array(n[:m]), pa.array(digests, pa.string()), pa.array(packed[:m], pa.binary()),
        pa.array(packed[m + 1 :], pa.binary()), *map(pa.array, near),
    ]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and the columns `COMPARED` of every row of `docs` (doc_id, text).

    The next row is the one that follows by doc_id (null ones first), by the text's 64-bit hash and
    by the text; that of the last is the first, so a single row follows itself. Null texts are empty
    ones. Rows that agree in both columns are interchangeable. Texts travel once, whatever their
    length; ids that many rows share are dealt by hash and place. No rows give none.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    order = ["doc_id", "tie", "text"]
    # Equal rows are spread by their place; which of them comes first changes nothing.
    dealt = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions(*order, "place")
    columns = ["doc_id", "part", "kind", "text", *COMPARED]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, part int, kind string, text string, " + ", ".join(f"{c} {t}" for c, t in COMPARED.items())
    empty = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None

        def rim(row: pa.Table, kind: str) -> pa.RecordBatch:
            some = [row.column("doc_id").combine_chunks(), pa.array([task], pa.int32()), pa.array([kind])]
            return pa.RecordBatch.from_arrays(
                [*some, row.column("text").combine_chunks(), *(pa.nulls(1, t) for t in empty)], columns
            )

        for part in tx.slices(batches):
            part = pa.Table.from_batches([part]).select(["doc_id", "text"])
            if held is None:
                yield rim(part.slice(0, 1), "head")
            else:
                part = pa.concat_tables([held, part])
            m = part.num_rows - 1
            held = pa.concat_tables([part.slice(m, 1)]).combine_chunks()
            if m:
                done = [part.column("doc_id").combine_chunks().slice(0, m), pa.array([task] * m, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*done, pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), *compared(part.column("text"))], columns
                )
        if held is not None:
            yield rim(held, "tail")

    found = written(dealt.select("doc_id", "text").mapInArrow(run, schema), "compared")
    heads = found.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # A row per task, of whole numbers alone, is small enough for one window.
    by_part = Window.orderBy("part")
    follow = found.where("kind = 'head'").select(
        "part",
        F.coalesce(
            F.lead("part").over(by_part),
            F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("next_part"),
    )
    tails = found.where("kind = 'tail'").select("doc_id", "text", "part").join(follow, "part").join(heads, "next_part")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = pa.array([batch.column("text")[i].as_py(), batch.column("next_text")[i].as_py()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), *compared(pair)], ["doc_id", *COMPARED]
                )

    plain = f"doc_id {id_type}, " + ", ".join(f"{c} {t}" for c, t in COMPARED.items())
    rest = tails.select("doc_id", "text", "next_text").mapInArrow(close, plain)
    return found.where("kind IS NULL").select("doc_id", *COMPARED).unionByName(rest)
