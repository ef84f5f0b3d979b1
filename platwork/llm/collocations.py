"""Phrase mining by dynamic itemset counting.

The texts are dealt into `SHARDS` parts of equal shares, which are scanned in a cycle. Words are
counted from the start; a phrase of two to four words becomes active as soon as both its
subphrases (all words but the last, all but the first) have reached the threshold in what has been
counted so far, in the middle of a cycle as well, and is then counted for one full cycle. So a scan
of a part counts phrases of all lengths at once, and mining ends when no phrase is active any more.

No task holds the active phrases. Phrases that have reached the threshold are known to the tasks by
two Bloom filters, of all of them and of those that reached it within the last cycle: an occurrence
is counted if both its subphrases are in the first and one of them in the second. A filter never
misses a phrase, so every active one is counted in each part of its cycle; one that is let through
by accident or too early is counted too, and as a count carries the parts it covers, no part enters
twice. Filters have a fixed greatest size, beyond which they only let more through. Tasks sum before
the shuffle.

Phrases are counted by 64-bit hashes; a last scan counts the phrases found by their texts, and only
within one task are these known by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.frames import forget, written

LONGEST = 4
LEAST = 30
#: Parts of the texts that a cycle goes through.
SHARDS = 3
#: Bits of a filter at most (16 MB), and different phrases that a task sums before it hands them on.
FILTER_BITS, HELD = 1 << 27, 1 << 20
#: Phrases that are written out as text at a time.
SPELLED = 1 << 14
#: Different phrases in a part of a table of counts, about.
PART = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Filter:
    """A Bloom filter of 64-bit keys with two probes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64)

    def probes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return keys & mask, (keys >> np.uint64(32)) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        flat = self.words.view(np.uint8)
        a, b = self.probes(keys)
        out = (flat[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1
        some = np.flatnonzero(out)
        b = b[some]
        out[some] = (flat[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
        return out.view(bool)

    def add(self, keys: DataFrame) -> None:
        """Adds the column `key`; set bits are joined in Spark, so at most the filter itself comes back."""
        low = F.col("key").bitwiseAND(F.lit(self.bits - 1).cast("long"))
        high = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(self.bits - 1).cast("long"))
        probes = keys.select(F.explode(F.array(low, high)).alias("bit"))
        words = probes.groupBy(F.shiftright("bit", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("set")
        )
        found = words.toArrow()
        self.words[found.column("word").to_numpy()] |= found.column("set").to_numpy().view(np.uint64)


class Occurrences:
    """The words of a slice (text, lang) with all phrases that start at each."""

    def __init__(self, part: pa.RecordBatch, longest: int):
        self.words = w = tx.words(part.column("text"), _WORD, lower=True)
        coded = part.column("lang").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy().astype(np.int64)[w.doc]
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(_BREAK[w.data], dtype=np.int32)])
        self.joined = np.zeros(len(w.start), bool)  # to the next word, in one piece
        self.joined[:-1] = (w.doc[1:] == w.doc[:-1]) & (breaks[w.start[1:]] == breaks[w.start[:-1]])
        self.keys = [tx.mix(w.hash + seeds[self.lang]) if len(seeds) else w.hash]
        self.whole = [np.ones(len(w.start), bool)]
        for k in range(2, longest + 1):
            m = max(len(w.start) - k + 1, 0)
            self.keys.append(tx.mix(self.keys[-1][:m] * _STEP + w.hash[k - 1 :][:m]))
            self.whole.append(self.whole[-1][:m] & self.joined[k - 2 :][:m])

    def phrase(self, at: np.ndarray, k: int) -> pa.Array:
        """The text of the phrases of k words that start at the given words; some at a time, as the place of
        every byte takes eight."""
        parts = [self._phrase(at[i : i + SPELLED], k) for i in range(0, len(at), SPELLED)]
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    def _phrase(self, at: np.ndarray, k: int) -> pa.Array:
        w = self.words
        each = (at[:, None] + np.arange(k)).reshape(-1)
        # A word and a blank behind it; the blank may be any byte, so it is set afterwards.
        size = w.end[each] - w.start[each] + 1
        data = np.append(w.data, np.uint8(0x20))[tx.ranges(w.start[each], w.end[each] + 1)]
        ends = np.cumsum(size)
        data[ends - 1] = 0x20
        keep = np.ones(len(data), bool)
        keep[ends[k - 1 :: k] - 1] = False
        offsets = np.concatenate([[0], ends[k - 1 :: k] - np.arange(1, len(at) + 1)])
        return pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))
        ).cast(pa.string())


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(count[order], at) if len(at) else count[:0]


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and counts; keys as steps from one to the next, which are shorter."""
    return tx.packed(np.diff(key, prepend=np.uint64(0)).view(np.int64), n)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = tx.unpacked(data, 2)
    return np.cumsum(step.view(np.uint64), dtype=np.uint64), n


def count_active(
    texts: DataFrame, every, recent, first_cycle: bool, longest: int, bits: int, share: int
) -> DataFrame:
    """The occurrences of the active phrases in some texts, in 2^bits parts by the upper bits of keys.

    part, counts (keys and numbers, packed) and likely (the keys that occur `share` times or more).
    """
    shift = np.uint64(64 - bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merged() -> int:
            nonlocal keys, counts
            key, n = _counted(keys, counts)
            keys, counts = [key], [n]
            return len(key)

        def dealt() -> pa.RecordBatch:
            (key,), (n,) = keys, counts
            part = (key >> shift).astype(np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(at[1:], len(key))
            blobs = [_packed(key[a:b], n[a:b]) for a, b in zip(at.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], ["part", "counts"])

        for part in tx.slices(batches):
            o = Occurrences(part, longest)
            active = [o.keys[0]] if first_cycle else []
            if recent is not None:
                known, fresh = every.value.has(o.keys[0]), recent.value.has(o.keys[0])
                for k in range(2, longest + 1):
                    m = len(o.keys[k - 1])
                    use = np.flatnonzero(o.whole[k - 1] & known[:m] & known[1 : m + 1] & (fresh[:m] | fresh[1 : m + 1]))
                    active.append(o.keys[k - 1][use])
                    if k < longest:
                        # Longer phrases need subphrases that have reached the threshold, not active ones.
                        may = np.flatnonzero(o.whole[k - 1] & known[:m] & known[1 : m + 1])
                        yes = every.value.has(o.keys[k - 1][may])
                        new = recent.value.has(o.keys[k - 1][may[yes]])
                        known, fresh = np.zeros(m, bool), np.zeros(m, bool)
                        known[may[yes]], fresh[may[yes]] = True, new
            key = np.concatenate(active) if active else np.zeros(0, np.uint64)
            if len(key):
                key, n = _counted([key], [np.ones(len(key), np.int64)])
                keys.append(key)
                counts.append(n)
            if sum(map(len, keys)) > HELD and merged() > HELD // 2:
                yield dealt()
                keys, counts = [], []
        if keys:
            merged()
            yield dealt()

    def joined(group: pa.Table) -> pa.Table:
        own = [_unpacked(x) for x in group.column("counts").to_pylist()]
        key, n = _counted([k for k, _ in own], [n for _, n in own])
        return pa.table(
            [
                group.column("part").slice(0, 1), pa.array([_packed(key, n)], pa.binary()),
                pa.array([key[n >= share].view(np.int64).tolist()], pa.list_(pa.int64())),
            ],
            ["part", "counts", "likely"],
        )

    return texts.mapInArrow(run, "part long, counts binary").groupBy("part").applyInArrow(
        joined, "part long, counts binary, likely array<long>"
    )


def reaching(counts: list[DataFrame], hope, least: int, reached: list[DataFrame]) -> DataFrame:
    """key: the phrases in the filter whose counts reach the threshold now and are in none of the tables `reached`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("counts"):
                key, n = _unpacked(blob.as_py())
                some = np.flatnonzero(hope.value.has(key))
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(n[some])], ["key", "n"])

    rows = reduce(DataFrame.unionByName, counts).select("counts").mapInArrow(run, "key long, n long")
    summed = rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    return summed.join(reduce(DataFrame.unionByName, reached), "key", "left_anti") if reached else summed


def count_found(texts: DataFrame, every, longest: int) -> DataFrame:
    """lang, k (words), phrase, n: the occurrences of the phrases the filter knows, by their texts;
    and one row a lang with a null phrase, k 0 and the number of all its words."""
    names = ["lang", "k", "phrase", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, texts_of = [], [], []  # of a task so far: what it met, how often, and how it reads

        def told() -> Iterator[pa.RecordBatch]:
            key, n = _counted(keys, counts)
            seen = pa.concat_tables(texts_of).combine_chunks()
            known, at = np.unique(seen.column("key").to_numpy(), return_index=True)
            n = n[np.searchsorted(key, known)]
            out = seen.select(["lang", "k", "phrase"]).take(pa.array(at)).append_column("n", pa.array(n))
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

        for part in tx.slices(batches):
            o = Occurrences(part, longest)
            langs = pa.array(o.langs, pa.string())
            n = np.bincount(o.lang, minlength=len(langs)).astype(np.int64)
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [langs, pa.array([0] * m, pa.int32()), pa.nulls(m, pa.string()), pa.array(n)], names
            )
            known = np.ones(len(o.keys[0]) + 1, bool)
            for k in range(1, longest + 1):
                m = len(o.keys[k - 1])
                may = np.flatnonzero(o.whole[k - 1] & known[:m] & known[1 : m + 1])
                at = may[every.value.has(o.keys[k - 1][may])]
                known = np.zeros(m + 1, bool)
                known[at] = True
                if not len(at):
                    continue
                key, first, n = np.unique(o.keys[k - 1][at], return_index=True, return_counts=True)
                new = np.ones(len(key), bool)
                if keys:
                    new = keys[0][np.minimum(np.searchsorted(keys[0], key), len(keys[0]) - 1)] != key
                keys.append(key)
                counts.append(n)
                own = at[first[new]]
                texts_of.append(
                    pa.table(
                        [
                            pa.array(key[new]), langs.take(pa.array(o.lang[own])),
                            pa.array(np.full(len(own), k, np.int32)), o.phrase(own, k),
                        ],
                        ["key", "lang", "k", "phrase"],
                    )
                )
            # Merged when what came since is as much again; what is named twice until then is told once.
            if keys and sum(map(len, keys[1:])) > max(len(keys[0]), HELD // 4):
                key, n = _counted(keys, counts)
                keys, counts = [key], [n]
                if len(key) > HELD:
                    yield from told()
                    keys, counts, texts_of = [], [], []
        if keys:
            yield from told()

    counted = texts.mapInArrow(run, "lang string, k int, phrase string, n long")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """lang, k, phrase, n of all phrases of 1 to `longest` words that occur `least` times or more in the
    texts of a lang, and a row of k 0 with the number of all its words, as a written table.

    A-Z count as a-z. Phrases lie within pieces between marks of punctuation and line ends, and
    overlapping occurrences all count. Null texts have no words, a null lang is `und`. Repeated rows
    count each, texts are taken whole, no rows give none; columns other than text and lang are not read.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.where("text IS NOT NULL").select(lang.alias("lang"), "text")
    # Any even deal will do, as it is written before the first scan; equal texts go to all parts alike.
    rows = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt = written(rows, "phrase-texts", by="shard")
    part = [dealt.where(F.col("shard") == s).select("lang", "text") for s in range(shards)]
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1 << 16
    while bits < min(size // 8, filter_bits):
        bits *= 2
    # At most some two phrases a word are counted in one scan, of six bytes a word.
    part_bits = max(1, int(size // (3 * shards * PART)).bit_length())
    context = docs.sparkSession.sparkContext
    every, news, hopes, counts, reached, sent = Filter(bits), [], [], [], [], [None, None]
    step = 0
    while step < shards or sent[1] is not None:
        # What reaches the threshold over all parts holds an equal share of it in one of them.
        counted = count_active(part[step % shards], *sent, step < shards, longest, part_bits, -(-least // shards))
        counts.append(written(counted, "phrase-counts"))
        hope = Filter(bits)
        hope.add(counts[-1].select(F.explode("likely").alias("key")))
        hopes = [*hopes, hope.words][-shards:]
        # The last counts of all parts: one cycle, in which no part enters twice.
        while len(counts) > shards:
            forget(counts.pop(0))
        hope.words = reduce(np.bitwise_or, hopes)
        asked = context.broadcast(hope)
        fresh = written(reaching(counts, asked, least, reached), "phrase-keys")
        asked.destroy()
        reached.append(fresh)
        new = Filter(bits)
        new.add(fresh)
        news = [*news, new.words][-shards:]
        every.words |= new.words
        recent = Filter(bits)
        for words in news:
            recent.words |= words
        for old in sent:
            if old is not None:
                old.destroy()
        sent = [context.broadcast(every), context.broadcast(recent)] if recent.words.any() else [None, None]
        step += 1
    for table in (*counts, *reached):
        forget(table)
    # Tasks name what they found, so fewer and longer ones have less to say; enough are left for all cores.
    whole = dealt.select("lang", "text")
    whole = whole.coalesce(max(context.defaultParallelism, whole.rdd.getNumPartitions() // 8))
    found = count_found(whole, context.broadcast(every), longest)
    found = written(found.where((F.col("n") >= least) | (F.col("k") == 0)), "phrases")
    forget(dealt)
    return found


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, longest: int = LONGEST, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each lang by how much they hang together.

    a, l and r count the phrase and the two parts of its weakest cut, n all words of the lang; score
    is floor(2000000 a / (l + r)), the lowest over the cuts, of equal ones the first. Phrases that a
    longer frequent one holds with four fifths of their occurrences or more are left out. Ranks go
    by score, then a, then the phrase's bytes. See `frequent_phrases` for nulls and other rows.
    """
    found = frequent_phrases(docs, least, longest, **options)
    parts = found.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    phrases = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")
    cuts = phrases.select("lang", "phrase", "k", "a", cut).select(
        "*", F.expr("substring_index(phrase, ' ', at)").alias("left"), F.expr("substring_index(phrase, ' ', at - k)").alias("right")
    )
    both = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("cast(a AS decimal(20,0)) * cast(2000000 AS decimal(8,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    weakest = (
        both.withColumn("score", score).groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.first("k").alias("k"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "at")).alias("m"))
    )
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " ")
            ),
        )
    )
    longer = (
        phrases.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = (
        weakest.join(longer, ["lang", "phrase"], "left")
        .where("longer IS NULL OR 100 * longer < 80 * a")
        .select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of a lang are the best among the best of its parts.
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    n = found.where("k = 0").select("lang", "n")
    return (
        ranked.where(F.col("rank") <= top).join(n, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
