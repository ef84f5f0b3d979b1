"""Repetition rules: how much of a text lies inside n-grams and lines that recur in it.

Rolling hashes of several n-gram lengths are taken over all words of a slice at once. A
longer n-gram can only recur where its first words do, so each length is looked for only
where the shorter one recurred.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.llm import text as tx

#: Highest share of word characters inside recurring n-grams, by n, and inside recurring lines.
#: A sentence said twice in a short text stays below them.
NGRAM_LIMITS = {5: 0.30, 6: 0.30, 7: 0.30, 8: 0.30, 9: 0.28, 10: 0.26}
LINE_LIMIT = 0.20
#: The base rule: fewest words, window of words, highest share of words in recurring windows.
LEAST_WORDS, WINDOW, WINDOW_LIMIT = 20, 8, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SALT = np.uint64(0xA24BAED4963EE407)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts and shares of each text of a slice."""
    w = tx.words(texts)
    n_docs, total = len(w.offsets) - 1, len(w.start)
    count = w.count
    letter = (w.data & 0xC0) != 0x80
    chars = tx.sums_by_text(letter & tx.NOT_BLANK[w.data], w.offsets)
    symbols = tx.sums_by_text(_SYMBOL[w.data], w.offsets)
    before = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(letter, out=before[1:])
    length = before[w.end] - before[w.start]

    dup_lines, line_chars = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    at = np.flatnonzero(w.data == 0x0A)
    if len(at):
        # Every text ends its last line; a feed ends a line and begins the next.
        bounds = np.unique(np.concatenate([w.offsets, at + 1]))
        start, end = bounds[:-1], bounds[1:]
        end = end - (w.data[end - 1] == 0x0A)
        doc = np.searchsorted(w.offsets, start, "right") - 1
        held = np.searchsorted(w.start, end) - np.searchsorted(w.start, start) > 0
        start, end, doc = start[held], end[held], doc[held]
        key = tx.mix(tx.span_hashes(w.data, start, end) + doc.astype(np.uint64) * _SALT)
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(key), bool)
        later[order[1:]] = key[order][1:] == key[order][:-1]
        dup_lines = np.bincount(doc[later], minlength=n_docs)
        own = np.concatenate([[0], np.cumsum(length)])
        inside = own[np.searchsorted(w.start, end)] - own[np.searchsorted(w.start, start)]
        line_chars = np.bincount(doc[later], inside[later], minlength=n_docs).astype(np.int64)

    worst = np.zeros(n_docs)
    over = np.zeros(n_docs, bool)
    repeat_words = np.zeros(n_docs, np.int64)
    alive = np.ones(total, bool)
    for n, limit in NGRAM_LIMITS.items():
        start, grams = tx.ngrams(w.hash, w.doc, n)
        use = alive[start]
        start, grams = start[use], grams[use]
        twice = tx.repeated(tx.mix(grams + w.doc[start].astype(np.uint64) * _SALT))
        start = start[twice]
        alive = np.zeros(total, bool)
        alive[start] = True
        if not len(start):
            break
        hit = tx.covered(total, start, n)
        share = tx.sums_by_text(np.where(hit, length, 0), w.first) / np.maximum(chars, 1)
        worst = np.maximum(worst, share)
        over |= share > limit
        if n == WINDOW:
            repeat_words = tx.sums_by_text(hit, w.first)
    line_share = line_chars / np.maximum(chars, 1)
    failed = (count < LEAST_WORDS) | (100 * repeat_words > WINDOW_LIMIT * count)
    return {
        "n_words": count,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & ~over & (line_share <= LINE_LIMIT),
        "dup_line_share": line_share,
        "dup_ngram_share": worst,
    }


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, shares and verdict; no shuffle.

    Null, empty and blank texts have no words: they fail the base rule and are not kept. Rows
    are judged one by one, so repeated ids and texts each get their own row; a null id stays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            found = measure(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
