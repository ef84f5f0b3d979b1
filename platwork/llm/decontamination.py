"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each slice of documents is a shard. Its suffixes are sorted by their words, and every suffix
of every benchmark item is looked up in that array by binary search, all of them in step. Words
that occur in no item can't be part of a match, so they share rank 0 and suffixes with such a
word among their first ones are left out of the array. Neighbouring hits on one diagonal make
the longest verbatim matches.

The benchmark is sent to the tasks in blocks of a fixed size. One block is the usual case; with
more, the documents pass block after block and carry what was found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.frames import written

WINDOW = 10
#: UTF-8 bytes of benchmark text sent to a task at once.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
MATCHES = pa.list_(
    pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
)
FOUND = {
    "leak_words": (pa.int64(), "long"),
    "leak_spans": (SPANS, "array<struct<start:long,end:long>>"),
    "leak_matches": (MATCHES, "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"),
}


@dataclass
class Suffixes:
    """The distinct first words of an item's suffixes that have one length, and their places.

    A place knows the word before it and the one behind those first words (-2 beyond the item).
    The places of a key lie in the order of the first, and `by_after` in that of the second.
    """

    length: int
    keys: list[np.ndarray]  # packed ranks, most significant first, in ascending order
    first: np.ndarray  # of each key's places
    item: np.ndarray
    word: np.ndarray
    before: np.ndarray
    after: np.ndarray
    by_after: np.ndarray

    def unlike(self, key: np.ndarray, value: np.ndarray, behind: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in a text and one of its key's places in items that have another word before
        (or behind) them: rows of `key` and numbers of places."""
        own = self.after[self.by_after] if behind else self.before
        base = max(int(own.max(initial=0)), int(value.max(initial=0))) + 3
        of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * base + own + 2
        wanted = key * base + value + 2
        low, high = np.searchsorted(of, wanted, "left"), np.searchsorted(of, wanted, "right")
        a, b = self.first[key], self.first[key + 1]
        row = np.concatenate([np.repeat(np.arange(len(key)), low - a), np.repeat(np.arange(len(key)), b - high)])
        place = np.concatenate([_ranges(a, low), _ranges(high, b)])
        return row, self.by_after[place] if behind else place


@dataclass
class Block:
    ids: list[str | None]
    vocabulary: np.ndarray
    suffixes: list[Suffixes]


def _packed(ranks: np.ndarray, at: np.ndarray, length: int, bits: int) -> list[np.ndarray]:
    """The ranks of `length` words from each place, several to a number."""
    per = 63 // bits
    out = []
    for low in range(0, length, per):
        key = np.zeros(len(at), np.int64)
        for j in range(low, min(low + per, length)):
            key = (key << bits) | ranks[at + j]
        out.append(key)
    return out


def _ascending(keys: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


def block_of(ids: list, texts: list, window: int = WINDOW) -> Block:
    """The search tables of some items. Items without words have none."""
    w = tx.words(pa.array(texts, pa.string()), tx.ALNUM, lower=True)
    vocabulary = np.unique(w.hash)
    bits = int(len(vocabulary) + 1).bit_length()
    ranks = np.searchsorted(vocabulary, w.hash) + 1
    lengths = np.minimum(w.count, window)
    suffixes = []
    for n in np.unique(lengths[lengths > 0]).tolist():
        left = np.repeat(w.first[1:], w.count) - np.arange(len(w.hash))
        at = np.flatnonzero((left >= n) & (np.repeat(lengths, w.count) == n))
        keys = _packed(ranks, at, n, bits)
        start, end = w.first[w.doc[at]], w.first[w.doc[at] + 1]
        before = np.where(at > start, ranks[np.maximum(at - 1, 0)], -2)
        after = np.where(at + n < end, ranks[np.minimum(at + n, len(ranks) - 1)], -2)
        order = np.lexsort([before, *keys[::-1]])
        keys, at, before, after = [k[order] for k in keys], at[order], before[order], after[order]
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = np.append(np.flatnonzero(new), len(at))
        item = w.doc[at]
        by_after = np.lexsort((after, np.cumsum(new)))
        suffixes.append(Suffixes(n, [k[new] for k in keys], first, item, at - w.first[item], before, after, by_after))
    return Block([None if i is None else str(i) for i in ids], vocabulary, suffixes)


def _bound(table: list[np.ndarray], wanted: list[np.ndarray], upper: bool) -> np.ndarray:
    """For each wanted key its place in the sorted table, by bisection of all at once."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(low), len(table[0]), np.int64)
    for _ in range(len(table[0]).bit_length()):
        middle = np.minimum((low + high) >> 1, len(table[0]) - 1)
        below = np.full(len(low), upper)
        for t, q in zip(table[::-1], wanted[::-1]):
            t = t[middle]
            below = (t < q) | ((t == q) & below)
        open_ = low < high
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one behind the other."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _diagonals(place: np.ndarray, item: np.ndarray, word: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item, word of the item and place, diagonal by diagonal."""
    doc = docs[place]
    order = np.lexsort((place, place - word, item, doc))
    return doc[order], item[order], word[order], place[order]


def search(texts: pa.Array, block: Block) -> tuple[np.ndarray, list[list], list[list]]:
    """Words of each text, its hit spans and its longest matches."""
    w = tx.words(texts, tx.ALNUM, lower=True)
    n_docs, total = len(w.count), len(w.hash)
    spans: list[list] = [[] for _ in range(n_docs)]
    matches: list[list] = [[] for _ in range(n_docs)]
    if not total or not len(block.vocabulary):
        return w.count, spans, matches
    near = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
    ranks = np.where(block.vocabulary[near] == w.hash, near + 1, 0)
    bits = int(len(block.vocabulary) + 1).bit_length()
    # The place behind the run of item words that each word begins or continues.
    stops = np.flatnonzero((ranks == 0) | (np.append(w.doc[1:] != w.doc[:-1], True)))
    run_end = stops + (ranks[stops] > 0)
    reach = run_end[np.searchsorted(stops, np.arange(total))] - np.arange(total)
    hit = np.zeros(total, bool)
    for s in block.suffixes:
        at = np.flatnonzero((ranks > 0) & (reach >= s.length))
        if not len(at):
            continue
        keys = _packed(ranks, at, s.length, bits)
        order = _ascending(keys)
        array, keys = at[order], [k[order] for k in keys]
        low, high = _bound(keys, s.keys, False), _bound(keys, s.keys, True)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        n = (high - low)[found]
        place, which = array[_ranges(low[found], high[found])], np.repeat(found, n)
        hit |= tx.covered(total, place, s.length)
        # A match begins where the words before differ and ends where those behind do. Along a
        # diagonal of a text and an item, beginnings and ends take turns, so only these are listed.
        previous = np.where(place > w.first[w.doc[place]], ranks[np.maximum(place - 1, 0)], -1)
        following = np.where(place + s.length < w.first[w.doc[place] + 1], ranks[np.minimum(place + s.length, total - 1)], -1)
        begins, ends = (
            _diagonals(place[row], s.item[of], s.word[of], w.doc)
            for row, of in (s.unlike(which, previous, False), s.unlike(which, following, True))
        )
        for d, i, word, a, b in zip(*(x.tolist() for x in (*begins, ends[3]))):
            matches[d].append(
                {"item_id": block.ids[i], "item_word": word, "doc_word": a - int(w.first[d]), "n_words": b - a + s.length}
            )
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    # A span that reaches over a text's end begins anew in the next text.
    inner = w.first[1:-1]
    inner = inner[(inner > 0) & (inner < total)]
    split = np.unique(inner[hit[inner] & hit[inner - 1]]) if len(inner) else inner
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
    for a, b in zip(starts.tolist(), ends.tolist()):
        d = int(w.doc[a])
        spans[d].append({"start": int(a - w.first[d]), "end": int(b - w.first[d])})
    return w.count, spans, matches


def _joined(old: list, new: list) -> list:
    """Both lists of spans as one, overlaps merged."""
    out: list[dict] = []
    for s in sorted([*(old or []), *new], key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None,
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns named in `keep` (all) of every document with leak_words, leak_spans, leak_matches.

    leak_words counts words, leak_spans are the word spans that item windows cover, leak_matches
    the longest verbatim matches, each with its item and place. Null texts and texts without
    words have none on either side. Null item ids keep their spans and have a null item_id;
    repeated ids and texts are looked up one by one. Columns of the input with these names are
    replaced. An empty benchmark finds nothing, no documents give no rows. Long texts are searched
    whole; in one that repeats itself as an item does, work and memory go with the words and the
    matches reported, not with the pairs of places that agree.
    """
    keep = [c for c in (keep or docs.columns) if c not in FOUND]
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n_blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // block_bytes)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    for b in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        block = docs.sparkSession.sparkContext.broadcast(
            block_of([r["item_id"] for r in own], [r["text"] for r in own], window)
        )
        last = b == n_blocks - 1
        carried = [c for c in rows.columns if c not in FOUND and (not last or c in keep)]

        def run(
            batches: Iterable[pa.RecordBatch], block=block, carried=tuple(carried), more=b > 0
        ) -> Iterator[pa.RecordBatch]:
            for part in tx.slices(batches, SHARD_BYTES):
                count, spans, matches = search(part.column("text"), block.value)
                if more:
                    spans = [_joined(o, n) for o, n in zip(part.column("leak_spans").to_pylist(), spans)]
                    matches = [o + n for o, n in zip(part.column("leak_matches").to_pylist(), matches)]
                found = [pa.array(count), pa.array(spans, SPANS), pa.array(matches, MATCHES)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), *found], [*carried, *FOUND]
                )

        schema = ", ".join(
            [*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried), *(f"{c} {t}" for c, (_, t) in FOUND.items())]
        )
        rows = rows.mapInArrow(run, schema)
        if not last:
            rows = written(rows, "leaks")
    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents no item's window occurs in, with their columns."""
    return find_leaks(docs, benchmark).where(F.size("leak_spans") == 0).select(*docs.columns)
