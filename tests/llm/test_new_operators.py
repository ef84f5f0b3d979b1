"""Locally consistent parsing, itemset counting of phrases and reversed search against brute force."""

import collections
import hashlib
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from platwork.llm import collocations, consistent, decontamination, mixing, ranking
from platwork.llm import text as tx
from tests.llm import cases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


# --- locally consistent parsing ---


def mix(x):
    return int(tx.mix(np.array([x % 2**64], np.uint64))[0])


def naive_level(symbols):
    """One level of the parse of one text: (symbols as bytes or names) to names."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    label = [s for s, _ in runs]
    for _ in range(4):
        new = []
        for i, s in enumerate(label):
            x = s ^ label[i - 1] if i else 1
            low = (x & -x).bit_length() - 1
            new.append(2 * low + (s >> low & 1) if i else s & 1)
        label = new
    names = [int(consistent._SYMBOL[s]) if isinstance(symbols, bytes) else s for s, _ in runs]
    names = [mix(n * int(consistent._RUN) + r) if r > 1 else n for n, (_, r) in zip(names, runs)]
    begin = [
        i for i in range(len(runs)) if not i or i + 1 < len(runs) and label[i - 1] < label[i] > label[i + 1]
    ]
    out = []
    for a, b in zip(begin, [*begin[1:], len(runs)]):
        out.append(mix(sum(names[j] * int(consistent._POWER[min(j - a, 63)]) for j in range(a, b)) + b - a))
    return out


def naive_names(text):
    symbols, level, found = text.encode(), 0, set()
    while symbols:
        symbols, level = naive_level(symbols), level + 1
        if level >= consistent.BASE or len(symbols) == 1:
            found |= set(symbols)
        if len(symbols) == 1:
            return found
    return found


def naive_sketch(text):
    values = sorted({mix(n ^ int(consistent._RUN)) >> 32 for n in naive_names(text)})
    return values[: consistent.KEPT], len(values) < consistent.KEPT


def naive_likeness(a, b):
    (x, x_all), (y, y_all) = naive_sketch(a), naive_sketch(b)
    union = sorted({*x, *y})
    if not (x_all and y_all):
        union = union[: consistent.KEPT]
    shared = len({*x} & {*y} & {*union})
    return 2 * shared / (len(union) + shared) if union else 1.0


def test_phrases_equal_a_plain_parse():
    texts = ["", "a", "aa", "ab", "abab" * 9, "x" * 500, "naïve café \U0001f600 " * 5, cases.PASSAGE, "one two three"]
    data, offsets = tx.buffers(pa.array(texts))
    owner, name = consistent.phrases(data, offsets)
    for i, t in enumerate(texts):
        assert set(name[owner == i].tolist()) == naive_names(t)


def test_equal_substrings_share_their_phrases_at_any_offset():
    inner = " ".join(f"mmm{i * i}" for i in range(200))
    alone = naive_names(inner)
    for before, behind in (("", " tail"), ("xyz ", ""), ("a longer head, " * 7, "!" * 33)):
        assert len(alone & naive_names(before + inner + behind)) > 0.7 * len(alone)


def test_next_and_edited_texts(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def order(row):
        i, t = row
        tie = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), seed=42)
        return (i is not None, i or 0, tie - 2**64 if tie >= 2**63 else tie, t or "")

    texts = sorted(texts, key=order)
    want = collections.Counter()
    for (i, t), (_, other) in zip(texts, [*texts[1:], texts[0]]):
        t, other = t or "", other or ""
        new = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        near = (naive_likeness(t, new), naive_likeness(t, other)) if len(t) < 5000 and len(other) < 5000 else None
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), near)] += 1
    for parts in (1, 5):
        rows = consistent.with_next(docs.repartition(parts)).collect()
        prints = {t: p for t, p in ((r.text, bytes(r.fingerprint)) for r in consistent.fingerprints(docs).collect())}
        found = collections.Counter()
        for r in rows:
            near = (r.near_edited, r.near_next)
            key = (r.doc_id, r.n_chars, r.edited_sha256)
            found[(*key, near if (*key, near) in want else None)] += 1
        assert found == want
        assert {bytes(r.fingerprint) for r in rows} == set(prints.values())
    assert consistent.with_next(cases.empty(spark)).collect() == []
    assert consistent.fingerprints(cases.empty(spark)).collect() == []
    (one,) = consistent.with_next(docs.where("doc_id = 6")).collect()
    assert one.near_next == 1.0 and one.n_chars == 13


def test_a_text_that_fills_the_table_goes_through_many_tasks(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text " * 5).alias("text"))
    found = consistent.with_next(rows)
    assert found.count() == 4000 and found.where("near_next < 1 OR near_edited < 0.3").count() == 0


# --- phrases ---


def naive_collocations(rows, top, least):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {}
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least:
            cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
            score, k = min((2000000 * a // (l + r), k) for k, (l, r) in enumerate(cuts))
            found[lang, w] = (score, a, *cuts[k])
    out = []
    for (lang, w), (score, a, left, right) in found.items():
        inside = [
            b for (m, v), (_, b, *_) in found.items()
            if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        ]
        if not any(100 * b >= 80 * a for b in inside):
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(r, *x) for r, x in enumerate(own[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("shards, bits", ((3, 1 << 27), (1, 1 << 27), (4, 64)))
def test_collocations_equal_plain_counts(spark, docs, shards, bits):
    """With a filter of 64 bits nearly everything is let through, and counts stay right."""
    words = ["red", "green", "blue", "very", "dark"]
    more = [
        (100 + i, " ".join(words[(i * j * j + j // 3) % 5] for j in range(9)) + ". red green  Blue\tdark! é ü", lang, "s", 0, "", "", "")
        for i in range(40)
        for lang in ("en", None, "und")
    ]
    df = cases.frame(spark, more).repartition(6)
    rows = [(r.text, r.lang) for r in df.select("text", "lang").collect()]
    found = collocations.collocations(df, top=12, least=7, shards=shards, filter_bits=bits).collect()
    got = sorted((r["rank"], r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)
    assert got == naive_collocations(rows, 12, 7) and got


def test_collocations_of_nothing(spark, docs):
    assert collocations.collocations(cases.empty(spark)).collect() == []
    assert collocations.collocations(docs.where("text IS NULL")).collect() == []


# --- search ---


def naive_ranking(docs, items, top):
    terms = [(i, collections.Counter(TERM.findall(small(t)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    merged = collections.defaultdict(collections.Counter)
    for i, t in items:
        merged[i].update(TERM.findall(small(t)))
    out = []
    for item, wanted in merged.items():
        scored = []
        for i, c in terms:
            n, score = sum(c.values()), 0
            for t, times in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1000000000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("block", (1 << 20, 60))
def test_search_equals_plain_scores(spark, docs, block):
    items = [
        (1, "the quick brown fox"), (2, "alpha1 beta2 alpha1, Alpha1"), (3, None), (4, "..."), (5, "one two three"),
        (5, "jumps over"), (None, "naïve CAFÉ and runs"), (6, "mmm1 mmm2 tail"), (7, "nowhere"), (8, "w1x1 w2x2"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for top in (2, 10):
        found = ranking.ranked(docs.repartition(4), table, top=top, block_bytes=block).collect()
        assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == naive_ranking(texts, items, top)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    assert ranking.ranked(cases.empty(spark), items).collect() == []
    assert ranking.ranked(docs, items.limit(0)).collect() == []


def test_heaps_stay_bounded_and_right():
    rng = np.random.default_rng(7)
    heaps, rows = ranking.Heaps(3, 4), []
    for _ in range(20):
        scores, ids = rng.integers(0, 6, (30, 3)), rng.integers(0, 1000, 30)
        heaps.offer(scores, ids, np.zeros(30, bool))
        rows += [(int(s), int(i), int(k)) for i, row in zip(ids, scores) for k, s in enumerate(row) if s]
        assert len(heaps.item) <= 12
    for k in range(3):
        best = sorted((-s, i) for s, i, item in rows if item == k)[:4]
        own = heaps.item == k
        assert list(zip((-heaps.score[own]).tolist(), heaps.id[own].tolist())) == best


# --- repeated words and rows in earlier operators ---


def naive_matches(text, items):
    """Longest common runs of words, diagonal by diagonal, that hold a window of the item."""
    d, out = cases.plain_words(text), set()
    for item, t in items:
        w = cases.plain_words(t)
        least = min(10, len(w))
        for shift in range(-len(w) + 1, len(d)) if w else ():
            run = 0
            for q in range(len(w) + 1):
                p = q + shift
                if q < len(w) and 0 <= p < len(d) and d[p] == w[q]:
                    run += 1
                    continue
                if run >= least:
                    out.add((str(item), q - run, p - run, run))
                run = 0
    return out


def test_matches_equal_a_plain_search():
    items = [(1, "a " * 15), (2, "x y z"), (3, "p q r s t u v w x y z a b"), (4, "a b " * 8), (5, "q")]
    texts = ["a " * 40, "q x y z x y z", "o p q r s t u v w x y z a b c", "a " * 12 + "b " + "a " * 11, "b a " * 20, ""]
    block = decontamination.block_of([i for i, _ in items], [t for _, t in items])
    _, _, found = decontamination.search(pa.array(texts), block)
    for text, own in zip(texts, found):
        got = [(m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in own]
        assert len(got) == len(set(got)) and set(got) == naive_matches(text, items)


def test_long_texts_of_one_word_stay_small():
    block = decontamination.block_of([1], ["a " * 1000])
    count, spans, found = decontamination.search(pa.array(["a " * 200_000]), block)
    assert count[0] == 200_000 and spans[0] == [{"start": 0, "end": 200_000}] and len(found[0]) == 200_981


def test_a_mix_of_equal_rows_meets_its_target(spark):
    rows = [(7, "w " * 100, "a", n) for n in range(31)] + [(8, "v " * 30, "a", 0)]
    rows += [(i, "u " * 50, "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(5)
    found = mixing.mixed(docs).toPandas()
    for _, own in found.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 50
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == found["copies"].sum()
    equal = out.where("doc_id = 7 AND source = 'a'").groupBy("extra").count().toPandas()["count"]
    assert len(equal) == 31 and equal.max() - equal.min() <= 1


def test_phrases_are_spelled_in_little_memory():
    words = [f"w{i % 97}" for i in range(100_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)]), pa.array(["en"])], ["text", "lang"])
    found = collocations.Occurrences(batch, 4)
    at = np.flatnonzero(found.whole[3])
    tracemalloc.start()
    spelled = found.phrase(at, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spelled.to_pylist() == [" ".join(words[i : i + 4]) for i in at]
    assert most < 16e6
    assert found.phrase(at[:0], 4).to_pylist() == []
