"""Substring deduplication by relative factoring against indexed blocks of the corpus.

Documents are cut into reference blocks by ranges of doc_id, so every document's references are
the blocks before its own and the smaller ids in its own block. A block indexes all its word
windows, each once, under its first document; the index lives hash-partitioned in buckets, where
a window of one block meets those of all others. Block numbers follow doc_id, so a bucket needs
no ids: a window that an earlier block holds too is a repeat.

A document is then parsed from left to right: a factor is the longest stretch whose windows all
recur before it, in whatever documents. Every window that straddles a factor's end is looked up
as well, so no repeat is lost at a boundary. The words of factors are the duplicate spans.

A window is known by 64 bits. Among 10^13 windows about one in a million would be taken for
a repeat by accident.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.frames import range_of, written
from platwork.llm.sharding import splitters

WINDOW = 13
#: UTF-8 bytes of text in a reference block, and behind a bucket of the index.
BLOCK_BYTES = 8 << 20

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Parsed:
    """The windows of a block's texts, in one order whatever order the rows come in."""

    def __init__(self, block: pa.Table, window: int, n_buckets: int, is_reference: bool):
        self.rows = block.take(pc.sort_indices(block, [("doc_id", "ascending"), ("text", "ascending")]))
        text = self.rows.column("text").combine_chunks()
        self.words = tx.words(text)
        ids = self.rows.column("doc_id").combine_chunks()
        rank = np.zeros(len(ids), np.int64)
        if is_reference and len(ids) > 1:
            rank[1:] = np.cumsum(np.diff(ids.to_numpy(zero_copy_only=False)) != 0)
        self.at, grams = tx.ngrams(self.words.hash, self.words.doc, window)
        n = len(grams)
        # Of equal windows the first one leads; those under greater ids repeat it.
        self.leader = np.arange(n)
        twice = np.flatnonzero(tx.repeated(grams))
        if len(twice):
            order = twice[np.argsort(grams[twice], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = grams[order][1:] != grams[order][:-1]
            begin = np.flatnonzero(new)
            self.leader[order] = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
        by_window = rank[self.words.doc[self.at]]
        self.repeats = by_window > by_window[self.leader]
        sent = np.flatnonzero(self.leader == np.arange(n))
        bucket = (((grams[sent] >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.sent, self.grams = sent[order], grams[sent[order]]
        self.bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _index_rows(window: int, n_buckets: int, n_reference: int):
    def run(key: tuple, block: pa.Table) -> pa.Table:
        number = key[0].as_py()
        p = Parsed(block, window, n_buckets, number < n_reference)
        held = np.flatnonzero(np.diff(p.bounds))
        raw = p.grams.tobytes()
        return pa.table(
            {
                "bucket": pa.array(held.astype(np.int32)),
                "block": pa.array(np.full(len(held), number, np.int32)),
                "windows": pa.array([raw[8 * p.bounds[b] : 8 * p.bounds[b + 1]] for b in held], pa.binary()),
            }
        )

    return run


def _recurring(n_reference: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        packed = [x.as_buffer() for c in rows.column("windows").chunks for x in c]
        size = np.array([len(x) // 8 for x in packed])
        grams = np.concatenate([np.frombuffer(x, np.uint64) for x in packed])
        owner = np.repeat(blocks, size)
        found = np.zeros(len(grams), bool)
        twice = np.flatnonzero(tx.repeated(grams))
        order = twice[np.lexsort((owner[twice], grams[twice]))]
        if len(order):
            new = np.ones(len(order), bool)
            new[1:] = grams[order][1:] != grams[order][:-1]
            begin = np.flatnonzero(new)
            least = np.repeat(owner[order][begin], np.diff(np.append(begin, len(order))))
            found[order] = (least < owner[order]) & (least < n_reference)
        parts = np.split(found, np.cumsum(size)[:-1])
        some = [i for i, x in enumerate(parts) if x.any()]
        return pa.table(
            {
                "block": pa.array(blocks[some].astype(np.int32)),
                "bucket": pa.array(np.full(len(some), key[0].as_py(), np.int32)),
                "found": pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary()),
            }
        )

    return run


def _factors(window: int, n_buckets: int, n_reference: int, keep: tuple[str, ...]):
    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        number = (key[0] if key[0].is_valid else answers.column("block")[0]).as_py()
        p = Parsed(block, window, n_buckets, number < n_reference)
        w, recurs = p.words, np.zeros(len(p.at), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("found")):
            low, high = p.bounds[b], p.bounds[b + 1]
            recurs[p.sent[low:high]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8))[: high - low] > 0
        recurs = recurs[p.leader] | p.repeats
        gone = tx.covered(len(w.hash), p.at[recurs], window)
        texts, spans, count = [], [], tx.sums_by_text(gone, w.first)
        for text, low, high, n in zip(p.rows.column("text"), w.first[:-1], w.first[1:], count):
            parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
            own = []
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[low:high].view(np.int8), [0]])))
                own = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                parts = [x for x, g in zip(parts, gone[low:high].tolist()) if not g]
            spans.append(own)
            texts.append(b" ".join(parts))
        return pa.table(
            {
                **{c: p.rows.column(c) for c in keep},
                "n_words": pa.array(w.count),
                "n_removed": pa.array(count),
                "duplicate_spans": pa.array(spans, SPANS),
                "text_kept": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    return run


def factored(
    docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns in `keep` (all) of every row with n_words, n_removed, duplicate_spans, text_kept.

    A word is removed if a window over it also starts in a row with a smaller doc_id. Rows with
    equal ids are no references of each other. A null id comes after all others and is nobody's
    reference. Null texts have no words and an empty text_kept; texts shorter than the window
    stay whole. text_kept joins the words left by one blank. Columns of the input with these
    names are replaced. An empty table gives no rows.
    """
    made = ("n_words", "n_removed", "duplicate_spans", "text_kept")
    keep = [c for c in (keep or docs.columns) if c not in made and not c.startswith("__")]
    sizes = written(
        docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")),
        "factor-sizes",
    )
    n_blocks = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    bounds = splitters(sizes, "doc_id", "size", n_blocks)
    n_reference = len(bounds) + 1
    number = F.coalesce(
        range_of(F.col("doc_id").cast("long"), bounds),
        (n_reference + F.pmod(F.xxhash64("text"), F.lit(n_blocks))).cast("int"),
    )
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]), number.alias("__block"))
    index = rows.groupBy("__block").applyInArrow(
        _index_rows(window, n_blocks, n_reference), "bucket int, block int, windows binary"
    )
    answers = index.groupBy("bucket").applyInArrow(_recurring(n_reference), "block int, bucket int, found binary")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return (
        rows.groupBy("__block").cogroup(answers.groupBy("block"))
        .applyInArrow(
            _factors(window, n_blocks, n_reference, tuple(keep)),
            f"{schema}, n_words long, n_removed long, "
            "duplicate_spans array<struct<start:long,end:long>>, text_kept string",
        )
    )
