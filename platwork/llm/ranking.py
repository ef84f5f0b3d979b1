"""Ranked lexical search, reversed: items are indexed, documents stream past.

An inverted index of the items' terms goes to the tasks; a document's term counts are looked up in
it, its scores for all items that share a term with it add up through the postings, and each item
keeps a heap of its best documents, which never holds more than `top`. The heaps of all tasks are
merged, of some tasks at first and then of all, so neither documents nor scores are shuffled.

Document frequencies and lengths are counted in a scan before. Items are taken in blocks of bounded
size, by hash of their id; with more than one block the documents pass once for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platwork.llm import text as tx

TOP = 10
#: UTF-8 bytes of item text in a block, as far as single items allow; and scores held at once.
BLOCK_BYTES, CELLS = 1 << 20, 1 << 22


@dataclass
class Index:
    """The items of a block and the postings of their terms, by ascending hash of the term."""

    ids: pa.Array
    terms: np.ndarray
    first: np.ndarray  # of each term's postings, and their number at the end
    item: np.ndarray
    repeats: np.ndarray

    def __post_init__(self):
        # Most words of a document are in no item: one bit of the hash's upper 20 tells.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.terms >> np.uint64(44)] = True

    def found(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts and terms that meet, ascending, and how often."""
        some = np.flatnonzero(self.maybe[w.hash >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.terms, w.hash[some]), len(self.terms) - 1)
        met = self.terms[at] == w.hash[some] if len(self.terms) else np.zeros(0, bool)
        key = np.sort(w.doc[some[met]] * len(self.terms) + at[met])
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        key, times = key[start], np.diff(np.append(start, len(key)))
        return key // max(len(self.terms), 1), key % max(len(self.terms), 1), times


def index_of(ids: list, texts: list, id_type: pa.DataType) -> Index:
    """The index of some items; rows that share an id are one item."""
    place = {i: n for n, i in enumerate(dict.fromkeys(ids))}
    w = tx.words(pa.array(texts, pa.string()), tx.ALNUM, lower=True)
    item = np.array([place[i] for i in ids], np.int64)[w.doc]
    order = np.lexsort((item, w.hash))
    term, item = w.hash[order], item[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (item[1:] != item[:-1])
    start = np.flatnonzero(new)
    term, item, repeats = term[start], item[start], np.diff(np.append(start, len(term)))
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    first = np.flatnonzero(new)
    return Index(pa.array(list(place), id_type), term[first], np.append(first, len(term)), item, repeats)


def statistics(docs: DataFrame, index) -> tuple[int, int, Counter]:
    """Documents with a term, all their terms, and the documents that hold each term of the index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(index.value.terms), np.int64)
        for part in tx.slices(batches):
            w = tx.words(part.column("text"), tx.ALNUM, lower=True)
            n, length = n + int((w.count > 0).sum()), length + len(w.hash)
            df += np.bincount(index.value.found(w)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n, length], df[some]]))], ["term", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # As many rows as the block has terms, at most half as many as its bytes.
    counts = counted.toArrow().to_pydict()
    df = Counter(dict(zip(counts["term"], counts["n"])))
    return df.pop(-1, 0), df.pop(-2, 0), df


class Heaps:
    """The best documents of each item so far: by score, then by id with null ids last."""

    def __init__(self, n_items: int, top: int):
        self.n_items, self.top = n_items, top
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.least = np.ones(n_items, np.int64)  # the lowest score that may still enter

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of some documents (rows) for all items (columns)."""
        least = self.least
        if len(scores) > self.top and (least == 1).any():
            # Of the new ones, too, only the best can enter.
            least = np.maximum(least, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        doc, item = np.nonzero(scores >= least)
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[doc, item]])
        self.id = np.concatenate([self.id, ids[doc]])
        self.null = np.concatenate([self.null, null[doc]])
        order = np.lexsort((self.id, self.null, -self.score, self.item))
        start = np.searchsorted(self.item[order], np.arange(self.n_items))
        rank = np.arange(len(order)) - start[self.item[order]]
        kept = order[rank < self.top]
        full = order[rank == self.top - 1]
        self.least[self.item[full]] = self.score[full]
        self.item, self.score, self.id, self.null = self.item[kept], self.score[kept], self.id[kept], self.null[kept]


def best(docs: DataFrame, index, weight, n_docs: int, total: int, top: int, id_type: str) -> DataFrame:
    """item_id, item (its place in the block), doc_id, score, task: the heaps of every task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, heaps = index.value, Heaps(len(index.value.ids), top)
        for part in tx.slices(batches):
            w = tx.words(part.column("text"), tx.ALNUM, lower=True)
            doc, term, times = x.found(w)
            # Beyond 64 bits for long texts of a large corpus, so in Python's numbers, one a document.
            m = np.array([25 + 75 * n * n_docs // total for n in w.count.tolist()], np.int64)
            value = weight.value[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
            ids = part.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            most = max(1, CELLS // max(heaps.n_items, 1))
            for low in range(0, part.num_rows, most):
                high = min(low + most, part.num_rows)
                scores = np.zeros((high - low) * heaps.n_items, np.int64)
                a, b = np.searchsorted(doc, [low, high])
                while a < b:
                    c = min(b, a + max(1, int(np.searchsorted(np.cumsum(np.diff(x.first)[term[a:b]]), CELLS))))
                    many = np.diff(x.first)[term[a:c]]
                    posting = tx.ranges(x.first[term[a:c]], x.first[term[a:c] + 1])
                    cell = np.repeat(doc[a:c] - low, many) * heaps.n_items + x.item[posting]
                    np.add.at(scores, cell, np.repeat(value[a:c], many) * x.repeats[posting])
                    a = c
                heaps.offer(scores.reshape(high - low, heaps.n_items), ids[low:high], null[low:high])
        task = np.full(len(heaps.item), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [x.ids.take(pa.array(heaps.item)), pa.array(heaps.item), pa.array(heaps.id, mask=heaps.null), pa.array(heaps.score), pa.array(task)],
            ["item_id", "item", "doc_id", "score", "task"],
        )

    return docs.mapInArrow(run, f"item_id {id_type}, item long, doc_id long, score long, task long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the `top` rows of `docs` with the highest scores above 0.

    Equal scores go by ascending doc_id, null ids last; repeated rows of documents are ranked each,
    in places that are theirs to share. Items that share an id, null ones too, are one item of all
    their terms. Null texts have no terms; items without terms, and documents or items that are
    missing altogether, give no rows. Texts are taken whole. Terms are known by 64 bits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    context, parts = docs.sparkSession.sparkContext, []
    id_type = items.schema["item_id"].dataType.simpleString()
    for b in range(n_blocks):
        # A block of bounded size; its items are whole, so that their heaps are.
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).toArrow()
        block = index_of(own.column("item_id").to_pylist(), own.column("text").to_pylist(), own.schema.field("item_id").type)
        index = context.broadcast(block)
        n_docs, total, df = statistics(docs, index)
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in range(len(block.terms))]
        weight = context.broadcast(np.array(weights, np.int64))
        parts.append(best(docs, index, weight, n_docs, max(total, 1), top, id_type).withColumn("block", F.lit(b)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for key in (["block", "item", F.pmod("task", F.lit(256))], ["block", "item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")
