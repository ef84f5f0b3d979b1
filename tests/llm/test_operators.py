"""Every operator on awkward rows, on the test tables, and against brute force."""

import collections
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platwork.llm import chat, components, dartminhash, decontamination, factoring, mixing, quality, queries
from platwork.llm import repetition, secrets, sharding, text, toxicity
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


@pytest.fixture(scope="module")
def real(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables not present")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_words_and_hashes_hold_at_every_cut():
    texts = pa.array(["", None, "a b", "b  a\n", "é\tb", "x" * 70_000 + " a"])
    w = text.words(texts)
    raw = [t.encode().split() for t in texts.to_pylist() if t]
    assert w.count.tolist() == [0, 0, 2, 2, 2, 2]
    flat = [x for t in raw for x in t]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == flat
    by_word = collections.defaultdict(set)
    for x, h in zip(flat, w.hash.tolist()):
        by_word[x].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    assert text.words(texts.slice(3, 2)).hash.tolist() == w.hash[w.first[3] : w.first[5]].tolist()


def test_shards_hold_equal_parts(spark, docs, real):
    for df, n in ((docs, 4), (real, 16)):
        found = sharding.shard_by_ranges(df, n_shards=n, least_ranges=8)
        assert set(found.columns) == {*df.columns, "size", "shard", "slot"}
        out = found.toPandas()
        assert len(out) == df.count()
        largest = max(out["size"])
        assert out["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in pairs(df))
        for _, own in out.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))
            assert abs(own["size"].sum() - out["size"].sum() / n) <= largest + 1
        again = sharding.shard_by_ranges(df.repartition(3), n_shards=n, least_ranges=8)
        keep = ["doc_id", "text", "shard"]
        assert bag(again.select(keep).collect()) == bag(found.select(keep).collect())
    assert sharding.shard_by_ranges(cases.empty(spark)).collect() == []


def test_a_text_that_fills_the_table_is_spread_over_shards(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text again").alias("text"))
    counts = sharding.shard_by_ranges(rows, n_shards=8, least_ranges=32).groupBy("shard").count().collect()
    assert len(counts) == 8 and all(abs(r["count"] - 375) <= 1 for r in counts)


def test_repetition_equals_brute_force(spark, docs, real):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for df in (docs, real):
        found = bag(repetition.repetition(df).select("doc_id", *columns).collect())
        assert found == bag((i, *cases.repetition(t)) for i, t in pairs(df))
    assert repetition.repetition(cases.empty(spark)).collect() == []


def test_leaks_equal_brute_force(spark, docs, real):
    items = [(1, cases.PASSAGE), (2, "one two three"), (3, None), (4, ""), (None, "naïve café"), (5, cases.PASSAGE)]
    tables = [(docs, spark.createDataFrame(items, "item_id long, text string"))]
    tables.append((real, spark.read.parquet(f"{FOLDER}/benchmark.parquet")))
    for df, bench in tables:
        own = [(r.item_id, r.text) for r in bench.collect()]
        want = bag((i, *x) for (i, t), x in zip(pairs(df), cases.leaks([t for _, t in pairs(df)], own)))
        for block in (1 << 23, 200):
            found = decontamination.find_leaks(df, bench, keep=["doc_id"], block_bytes=block)
            got = []
            for r in found.collect():
                ids = sorted({m.item_id for m in r.leak_matches if m.item_id is not None})
                hit = sum(s.end - s.start for s in r.leak_spans)
                got.append((r.doc_id, r.leak_words, hit, len(ids), cases.sha(",".join(ids)), hit > 0))
            assert bag(got) == want
        clean = decontamination.decontaminated(df, bench)
        assert clean.columns == df.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminated(docs, none).count() == docs.count()
    assert decontamination.decontaminated(cases.empty(spark), tables[0][1]).collect() == []


def test_longest_matches_have_their_places():
    block = decontamination.block_of([7], ["a b c d e f g h i j k l m"])
    _, spans, matches = decontamination.search(pa.array(["x a b c d e f g h i j k l z"]), block)
    assert spans == [[{"start": 1, "end": 13}]]
    assert matches == [[{"item_id": "7", "item_word": 0, "doc_word": 1, "n_words": 12}]]


@pytest.mark.parametrize("block", (8 << 20, 2_000))
def test_factors_equal_brute_force(spark, docs, real, block):
    for df in (docs, real):
        found = factoring.factored(df, block_bytes=block)
        assert [c for c in found.columns if c in df.columns] == df.columns
        got = bag(
            (r.doc_id, r.n_words, r.n_removed, cases.sha(r.text_kept)) for r in found.collect()
        )
        assert got == bag((i, *x) for (i, _), x in zip(pairs(df), cases.factors(pairs(df))))
    assert factoring.factored(cases.empty(spark)).collect() == []


def test_near_classes_equal_brute_force(spark, docs, real):
    for df in (docs, real):
        want = bag(zip([i for i, _ in pairs(df)], cases.near_classes(pairs(df))))
        assert bag(dartminhash.near_classes(df).select("doc_id", "class_id").collect()) == want
        left = dartminhash.without_near_duplicates(df)
        assert left.columns == df.columns
        n = len({c for c in cases.near_classes(pairs(df)) if c is not None})
        assert left.where("doc_id IS NOT NULL").count() == n
    assert dartminhash.near_classes(cases.empty(spark)).collect() == []


def test_copies_in_one_group_link_without_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(120):
        own = list(base)
        for k in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            own[k] = f"n{i}x{k}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = dict(zip([i for i, _ in texts], cases.near_classes(texts)))
    assert {r.doc_id: r.class_id for r in dartminhash.near_classes(df).collect()} == want


def test_signatures_agree_as_weighted_sets_are_alike():
    a = "a b c d e f g h i j k l m n o p q r s t".split()
    left = " ".join(a * 2)
    right = " ".join(a * 2 + ["z"] * 9)
    w = text.words(pa.array([left, right]))
    doc, grams = dartminhash.shingles(w, 1)
    ranks = dartminhash.signatures(doc, grams, 2, 4000)
    assert abs((ranks[0] == ranks[1]).mean() - 40 / 49) < 0.03
    assert not np.isinf(ranks).any()


def test_components_have_the_least_node(spark):
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), (5, 4), (3, 9), *((100 + i, 101 + i) for i in range(40))]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 4: 4, 5: 4, **{100 + i: 100 for i in range(41)}}
    assert {r.node: r.label for r in found} == want


def learned(spark, n=600):
    """Texts in which one word in ten tells the class, and labels of most of them."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [f"w{x}" for x in rng.integers(0, 200, 60)]
        if bad:
            for k in rng.choice(60, 6, replace=False):
                w[k] = rng.choice(["vile", "Nasty,", "rotten"])
        rows.append((i, " ".join(w) if i % 50 else None))
        if i % 9:
            labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (5, None, None), (10_000, 1, 1)]
    return (
        spark.createDataFrame([*rows, (None, "vile"), (3, "")], "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        rows,
    )


def checked_scores(found, remainder, parts, n):
    assert len(found) == n
    assert ((found.score >= 0) & (found.score <= 1)).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    known = found[found.doc_id.notna()]
    held = [zlib.crc32(str(int(i)).encode()) % parts == remainder for i in known.doc_id]
    assert (known.held_out == held).all() and not found[found.doc_id.isna()].held_out.any()


def test_toxicity_tells_held_out_texts(spark):
    df, labels, rows = learned(spark)
    found = toxicity.toxicity(df, labels).toPandas()
    checked_scores(found, 2, 4, 602)
    held = found[found.held_out].set_index("doc_id")
    bad = {i for i, t in rows if i % 4 == 0 and t}
    right = [(p == 1) == (i in bad) for i, p in held.predicted.items()]
    assert np.mean(right) > 0.95
    left = toxicity.without_toxic(df, labels)
    assert left.columns == df.columns and 400 < left.count() < 520


def test_toxicity_model_is_the_plain_one(spark, monkeypatch):
    """Every pair of words by its own counts, in many slices and parts as in one."""
    monkeypatch.setattr(toxicity, "SLICE", 400)
    monkeypatch.setattr(toxicity, "HELD", 64)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 5000), int(i % 3 == 0)) for i in range(60)]
    rows += [(60, None, 0), (61, "", 1), (62, "w1 w1 w1", 1), (63, "Never seen, w2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5, "doc_id")
    known = [r for r in rows if r[0] < 40]
    model = toxicity.Model(df.where("doc_id < 40"), 3)
    pairs = [collections.Counter(), collections.Counter()]
    for _, t, y in known:
        w = ["", *cases.plain_words(t)]
        pairs[y].update(set(zip(w, w[1:])))
    parts = [toxicity.pairs_of([r.pairs]) for r in model.parts.collect() if r.pairs]
    assert len(parts) > 4 and sum(len(p) for p in pairs) == sum((t > 0).sum() + (o > 0).sum() for _, _, t, o in parts)
    both = set(pairs[0]) | set(pairs[1])
    follows = collections.Counter(w for _, w in both)

    def discount(n):
        once, twice = (sum(v == k for v in n.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def chance(y, h, w):
        n, after = pairs[y], collections.Counter(x for _, x in pairs[y])
        d = discount(after)
        shared = (follows[w] + 1) / (len(both) + len(follows) + 1)
        p = (max(after[w] - d, 0) + d * len(after) * shared) / len(n)
        return by_pair(n, h, w, by_pair(pairs[0] + pairs[1], h, w, shared) * p / shared)

    def by_pair(n, h, w, back):
        d, own = discount(n), {x: v for (g, x), v in n.items() if g == h}
        total = sum(own.values())
        return (max(own.get(w, 0) - d, 0) + d * len(own) * back) / total if total else back

    want = {}
    for i, t, _ in rows:
        w = ["", *cases.plain_words(t)]
        logs = [np.log(chance(1, *g) / chance(0, *g)) for g in zip(w, w[1:])]
        want[i] = np.mean(logs) if logs else 0.0
    found = {r.doc_id: r.features for r in toxicity.measures(df, model, ["doc_id"]).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[i][0] - want[i]) < 1e-9 for i in want)
    # The stretches, each by itself.
    for i, t, _ in rows:
        w = ["", *cases.plain_words(t)]
        logs = [np.log(chance(1, *g) / chance(0, *g)) for g in zip(w, w[1:])]
        tops = [max((sum(logs[a : a + n]) / n for a in range(len(logs))), default=0.0) for n in toxicity.STRETCHES]
        assert np.allclose(found[i][1:], [*tops, np.log1p(len(logs))], rtol=0, atol=1e-9)


def test_toxicity_curve_is_a_plain_logistic_fit():
    """Newton's weights leave no slope of the penalised likelihood."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 2, -1]
    y = (x[:, 0] + rng.normal(size=500) > 0.5).astype(float)
    centre, scale, w = toxicity.curve(x, y)
    z = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(500)])
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.array([1, 1, 1, 1e-6]) * w
    assert np.abs(slope).max() < 1e-6


def test_toxicity_keeps_columns_of_any_name(spark):
    df, labels, _ = learned(spark)
    odd = df.selectExpr("*", "1 AS features", "2 AS `Features_`", "3 AS `__mean`", "4 AS slice")
    left = toxicity.without_toxic(odd, labels)
    assert left.columns == odd.columns and left.select("features", "Features_", "__mean", "slice").distinct().count() == 1
    assert left.count() == toxicity.without_toxic(df, labels).count()


def test_models_without_labels_answer_all(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    for labels, score in ((none, 0.0), (one, None)):
        for f, parts, rest in ((toxicity.toxicity, 4, 2), (quality.quality, 5, 0)):
            found = f(docs, labels).toPandas()
            checked_scores(found, rest, parts, docs.count())
            if score is not None:
                assert (found.score == score).all()
    assert toxicity.without_toxic(docs, none).count() == docs.count()
    for f in (toxicity.toxicity, quality.quality):
        assert f(cases.empty(spark), one).collect() == []


def test_quality_tells_held_out_texts(spark, docs):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(800):
        good = i % 3 > 0
        w = [f"word{x}" for x in rng.integers(0, 500, 80)]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    found = quality.quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    checked_scores(found, 0, 5, df.count())
    held = found[found.held_out & (found.doc_id > 20)]
    assert ((held.predicted == 1) == (held.doc_id % 3 > 0)).mean() > 0.97


def test_isotonic_pools_what_is_out_of_order():
    n, ones = np.array([1.0, 2, 1, 4]), np.array([1.0, 0, 1, 3])
    assert quality.isotonic(n, ones).tolist() == pytest.approx([1 / 3, 1 / 3, 0.8, 0.8])


def test_literals_are_in_every_match():
    found = {r.kind: secrets.literals(r.pattern) for r in secrets.RULES}
    assert found["hex"] == [] and found["access"] == [["akia"]]
    assert {"password", "api_key", "apikey"} <= set(found["assign"][0])
    assert secrets.literals("ab[xy]c+d") == [["abx", "aby"]]
    assert secrets.literals("(one|tw)three?") == [["onethre", "onethree", "twthre", "twthree"]]


def test_secrets_equal_brute_force(spark, docs, real):
    import re

    for df in (docs, real):
        want = []
        for i, t in pairs(df):
            spans = []
            for k, r in enumerate(secrets.RULES):
                for m in re.compile(r.pattern, (re.I if r.any_case else 0) | re.A).finditer(t or ""):
                    if len(m[r.group]) >= r.least:
                        spans.append((m.start(), k, m.end()))
            want.append((i, ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans))))
        found = secrets.secrets(df)
        assert found.columns == [*df.columns, "secret_spans"]
        got = found.select("doc_id", secrets.written_spans(F.col("secret_spans")).alias("s")).collect()
        assert bag(got) == bag(want)
    assert secrets.secrets(cases.empty(spark)).collect() == []


def test_mixing_comes_near_its_targets(spark, docs, real):
    for df in (docs, real):
        out = mixing.mixed(df).toPandas()
        assert len(out) == df.count()
        sizes = bag((i, len(cases.blank_words(t))) for i, t in pairs(df))
        assert bag((None if i != i else i, n) for i, n in zip(out.doc_id, out["size"])) == sizes
        total = out["size"].sum()
        per = out.groupby("source", dropna=False).agg(
            target=("target", "first"), taken=("taken", "sum"), own=("size", "sum"), largest=("size", "max")
        )
        assert per.target.sum() == pytest.approx(1.5 * total)
        assert (per.target <= 2 * per.own + 1e-9).all()
        assert (abs(per.taken - per.target) <= per.largest / 2 + 1).all()
        assert (out.taken <= 2 * out["size"]).all()
        again = mixing.mixed(df.repartition(5)).toPandas()
        assert bag(again[["doc_id", "size", "taken"]].fillna(-1).to_numpy().tolist()) == bag(
            out[["doc_id", "size", "taken"]].fillna(-1).to_numpy().tolist()
        )
    copies = mixing.mixture(real)
    assert copies.columns == real.columns
    assert copies.count() == mixing.mixed(real).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(cases.empty(spark)).collect() == []


def test_transcripts_come_back(spark):
    talk = [
        (c, t, role, f"{'why so' if role == 'user' else 'because of that'} {c} {t}\nand more {'?' if role == 'user' else 'words ' * 30}")
        for c in range(60)
        for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])
    ]
    talk += [(70, 0, None, "who speaks"), (70, 1, "user", None), (None, 0, "user", "no id"), (71, None, "user", "no turn")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    lines = chat.transcripts(df).cache()
    model = chat.fit(lines)
    plain = lines.select("conv_id", "line_no", "i", "line")
    whole = chat.recovered_lines(plain, model).cache()
    assert bag(whole.select(plain.columns).collect()) == bag(plain.collect())
    # Small chunks find the very same path.
    cut = chat.recovered_lines(plain, model, chunk=3).cache()
    assert cut.select("chunk").distinct().count() > 20
    keep = ["conv_id", "line_no", "i", "role", "opens"]
    assert bag(cut.select(keep).collect()) == bag(whole.select(keep).collect())
    turn_of = {r.line_no: r.turn for r in lines.collect()}
    found = {(r.conv_id, turn_of[r.line_no]): r for r in chat.turns(whole).collect()}
    right = [found.get((c, t)) and found[c, t].role == r for c, t, r, _ in talk if c is not None and c < 60]
    assert np.mean([bool(x) for x in right]) > 0.95
    assert found[0, 2].text.startswith("because of that 0 2\nand more")
    assert bag((r.conv_id, r.line_no, r.i, r.text) for r in chat.turns(cut).collect()) == bag(
        (r.conv_id, r.line_no, r.i, r.text) for r in chat.turns(whole).collect()
    )
    none = spark.createDataFrame([], "conv_id long, line_no long, line string")
    assert chat.turns(chat.recovered_lines(none, model)).collect() == []
    assert chat.transcripts(df.limit(0)).collect() == []


def test_transcripts_lose_no_line(spark):
    """Repeated rows, lines under one number, null ids and a very long turn."""
    talk = [(1, 0, "user", "what now?"), (1, 0, "user", "what now?"), (1, 1, "assistant", "this\nthat\nthis")]
    talk += [(None, 0, "user", "no id")] * 3 + [(2, 0, "user", "line\n" * 5000), (2, 1, "assistant", None)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    lines = chat.transcripts(df).cache()
    # Every row's text comes whole, behind its marker.
    held = collections.defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: (r.line_no, r.i)):
        held[r.line_no].append(r.line)
    texts = sorted((t or "" for _, _, _, t in talk), key=len)
    assert all(x.endswith(t) for x, t in zip(sorted(map("\n".join, held.values()), key=lambda x: len(max(texts, key=lambda t: len(t) * x.endswith(t)))), texts))
    assert lines.select("line_no", "i").distinct().count() == lines.count()
    assert sorted(r.line_no for r in lines.select("line_no").distinct().collect()) == list(range(len(talk)))
    model = chat.fit(lines)
    found = chat.recovered_lines(lines, model, chunk=64).cache()
    assert bag(found.select("conv_id", "line").collect()) == bag(lines.select("conv_id", "line").collect())
    assert found.groupBy("conv_id", "chunk").count().selectExpr("max(count)").first()[0] <= 64
    assert chat.turns(found).selectExpr("sum(n_lines)").first()[0] == lines.count()
    same = spark.createDataFrame([(None, 7, "a?"), (None, 7, "a?"), (None, 7, None), (None, None, "x")], "conv_id long, line_no long, line string")
    assert bag(chat.recovered_lines(same, model).select("line_no", "line").collect()) == bag([(7, "a?"), (7, "a?"), (7, "")])


def test_transcripts_take_the_best_of_all_paths(spark):
    """Viterbi's path against every path there is."""
    rng = np.random.default_rng(11)
    said = ["User: why?", "Assistant: so", "because", "", "System: be brief", "more?", "x" * 50]
    talk = [(c, t, chat.ROLES[rng.integers(3)], "\n".join(rng.choice(said, rng.integers(1, 4)))) for c in range(30) for t in range(4)]
    lines = chat.transcripts(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    model = chat.fit(lines)
    short = [(c, n, str(x)) for c in range(12) for n, x in enumerate(rng.choice(said, 1 + c % 5))]
    plain = spark.createDataFrame(short, "conv_id long, line_no long, line string").withColumn("seen", chat.observation(F.col("line")))
    seen = {(r.conv_id, r.line_no): r.seen for r in plain.collect()}
    found = {(r.conv_id, r.line_no): (r.role, r.opens) for r in chat.recovered_lines(plain, model, chunk=2).collect()}
    first = chat._entry(model)
    first = (first[:, None] + model["move"]).max(axis=0)

    def worth(path, c):
        return first[path[0]] + sum(model["move"][a, b] for a, b in zip(path, path[1:])) + sum(
            model["seen"][seen[c, n], s] for n, s in enumerate(path)
        )

    for c in range(12):
        n = 1 + c % 5
        mine = [2 * chat.ROLES.index(found[c, i][0]) + (not found[c, i][1]) for i in range(n)]
        assert abs(worth(mine, c) - max(worth(p, c) for p in itertools.product(range(chat.STATES), repeat=n))) < 1e-9


def test_pipeline_keeps_and_drops(spark, real):
    import corpus_pipeline

    out = real
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, FOLDER)
        assert out.columns == real.columns, name
    final = corpus_pipeline.run(spark, FOLDER)
    assert final.count() > 100
    assert final.select("shard", "slot").distinct().count() == final.count()
    assert decontamination.decontaminated(final, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == final.count()


def test_every_operator_is_registered():
    names = set(queries.QUERIES)
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{i}" for i in range(1, 11)}
