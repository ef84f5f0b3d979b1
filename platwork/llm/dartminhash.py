"""Near-duplicate detection by DartMinHash over word shingles.

A text is a weighted set: its shingles of five words with the times they occur. Every unit of
weight of every element is a region on which hashed darts fall as a Poisson process along the
rank axis, the same darts for every text that holds the region. A text throws as many darts as
fill all coordinates of its signature whatever its length, about k ln k + 2k, and keeps the
earliest in each coordinate; two texts agree in a coordinate with the chance of their weighted
Jaccard similarity. Coordinates are joined in bands.

Equal texts are folded first. In each band every text is compared with two hubs, by the exact
similarity of the whole texts. What still shares a band across the components of these links is
compared pair by pair, save where the shingles that occur nowhere else rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.llm import text as tx
from platwork.llm.components import components
from platwork.llm.frames import written

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold shares no band with a chance of 4e-4.
BANDS, ROWS = 20, 5
SALTS = 8
#: Coordinates of the one-bit sketches that are compared before whole texts are, and how many
#: standard deviations a pair at the threshold may be off; it is missed with a chance of 4e-6.
SKETCH, SURE = 1024, 4.5

_COPY = np.uint64(0xC2B2AE3D27D4EB4F)
_DART = np.uint64(0x165667B19E3779F9)
_SALT = np.uint64(0xA24BAED4963EE407)


def shingles(w: tx.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer words, but not none, is one shingle."""
    at, grams = tx.ngrams(w.hash, w.doc, n)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        size = w.count[short]
        owner = np.repeat(np.arange(len(short)), size)
        places = np.repeat(w.first[short] - np.cumsum(size) + size, size) + np.arange(size.sum())
        position = (places - w.first[short][owner]).astype(np.uint64)
        whole = np.zeros(len(short), np.uint64)
        np.add.at(whole, owner, tx.mix(w.hash[places] + position * _SALT))
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, tx.mix(whole)])
    return doc, grams


def units(doc: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Every occurrence of an element as a region of its own: first, second, ... of its text."""
    twice = np.flatnonzero(tx.repeated(tx.mix(grams + doc.astype(np.uint64) * _SALT)))
    if not len(twice):
        return tx.mix(grams)
    order = twice[np.lexsort((grams[twice], doc[twice]))]
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (grams[order][1:] != grams[order][:-1])
    begin = np.flatnonzero(new)
    number = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    out = grams.copy()
    out[order] += number.astype(np.uint64) * _COPY
    return tx.mix(out)


def signatures(doc: np.ndarray, grams: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The earliest dart's rank in each of k coordinates of each text; infinite without shingles."""
    region = units(doc, grams)
    weight = np.bincount(doc, minlength=n_docs)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    best = np.full(n_docs * k, np.inf)
    while len(doc):
        rank, owner, seed, j = np.zeros(len(doc)), doc, region, 0
        while len(owner):
            j += 1
            dart = tx.mix(seed + np.uint64(j * int(_DART) % (1 << 64)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank <= limit[owner]
            rank, owner, seed, dart = rank[near], owner[near], seed[near], dart[near]
            coordinate = ((tx.mix(dart) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            np.minimum.at(best, owner * k + coordinate.astype(np.int64), rank)
        open_ = np.isinf(best).reshape(n_docs, k).any(axis=1)
        limit = np.where(open_, 2 * limit, limit)
        again = open_[doc]
        doc, region = doc[again], region[again]
    return best.reshape(n_docs, k)


def bands_of(texts: pa.Array, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, and its band keys."""
    w = tx.words(texts, tx.ALNUM, lower=True)
    doc, grams = shingles(w)
    n_docs = len(w.count)
    rank = signatures(doc, grams, n_docs, bands * rows).view(np.uint64).reshape(n_docs, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _COPY, (n_docs, bands)).copy()
    for r in range(rows):
        key = tx.mix(key + rank[:, :, r])
    return np.bincount(doc, minlength=n_docs), key.view(np.int64)


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    sides = []
    for texts in (left, right):
        doc, grams = shingles(tx.words(texts, tx.ALNUM, lower=True))
        sides.append((tx.mix(units(doc, grams) + doc.astype(np.uint64) * _SALT), doc))
    (a, doc_a), (b, doc_b) = sides
    shared = np.bincount(doc_a[np.isin(a, b)], minlength=n)
    total = np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n) - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are as similar as asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            alike = pa.array(similarities(part.column("text"), part.column("other")) >= similarity)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(alike) for c in ("a", "b")], ["a", "b"])

    return (
        pairs.join(texts.select(F.col("node").alias("a"), "text"), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
        .select("a", "b", "text", "other")
        .mapInArrow(run, "a long, b long")
    )


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """Every text of a band with the hub of the band, and with that of its part of the band.

    The hub is the text whose own bands hold most texts: of copies that were changed here and
    there it is the least changed one, which is most alike to all.
    """
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = shared.join(weights, "node").select(
        "band", "node", F.pmod("node", F.lit(SALTS)).alias("salt"), F.struct("weight", "node").alias("rank")
    )
    parts = ranked.groupBy("band", "salt").agg(F.max("rank").alias("part_hub"))
    hubs = parts.groupBy("band").agg(F.max("part_hub").alias("hub"))
    return (
        ranked.join(parts, ["band", "salt"]).join(hubs, "band")
        .select("node", F.explode(F.array("hub.node", "part_hub.node")).alias("hub"))
        .where("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )


def _unmet_pairs(shared: DataFrame, labels: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one band but of different components that may be alike.

    Of a text's n shingles only the s that occur in any other text can be shared. With a partner
    of m shingles that bounds the similarity by o / (n + m - o), o the least of both s and both
    sizes. A text that can't reach the threshold with the smallest text of the band drops out
    before pairs are made, and so do most copies that differ from their group's hub by much. Of
    the others, sketches of one bit per coordinate tell which pairs are worth a comparison.
    """
    placed = shared.select("band", "node").join(labels, "node", "left").select(
        "band", "node", F.coalesce("label", "node").alias("label")
    )

    def across(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return rows.join(mixed.where("low < high").select("band"), "band")

    placed = written(across(placed), "near-mixed")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            doc, grams = shingles(tx.words(part.column("text"), tx.ALNUM, lower=True))
            order = np.argsort(doc, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(units(doc, grams)[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), held], ["node", "units"])

    sets = written(
        bodies.join(placed.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node long, units array<long>"),
        "near-units",
    )
    alone = (
        sets.select("node", F.explode("units").alias("unit"))
        .groupBy("unit").agg(F.count("*").alias("c"), F.first("node").alias("node"))
        .where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    )
    measured = sets.select("node", F.size("units").alias("size")).join(alone, "node", "left").select(
        "node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common")
    )

    def bound(size, common, other, least) -> Column:
        most = F.least(common, other, least)
        return most / (size + other - most)

    sized = placed.join(measured, "node")
    smallest = sized.groupBy("band").agg(F.min("size").alias("smallest"))
    # With a partner of `common` shingles all of which are shared the bound is greatest.
    partner = F.greatest("smallest", F.least("common", "size"))
    viable = written(
        across(
            sized.join(smallest, "band")
            .where(bound(F.col("size"), F.col("common"), partner, partner) >= similarity)
            .select("band", "node", "label", "size", "common")
        ),
        "near-viable",
    )

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            doc, grams = shingles(tx.words(part.column("text"), tx.ALNUM, lower=True))
            rank = signatures(doc, grams, part.num_rows, SKETCH).view(np.uint64)
            bits = np.packbits((tx.mix(rank) >> np.uint64(63)).astype(bool), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(list(bits))], ["node", "sketch"])

    bands = viable.groupBy("node").agg(F.collect_set("band").alias("bands"))
    sketches = (
        bodies.join(viable.select("node").distinct(), "node", "left_semi")
        .mapInArrow(sketched, "node long, sketch array<long>")
        .join(bands, "node")
    )
    columns = ("node", "label", "size", "common", "sketch", "bands")
    viable = written(viable.join(sketches, "node").select("band", *columns), "near-sketched")
    other = viable.select(*(F.col(c).alias(f"other_{c}") for c in ("band", *columns)))
    # Two sketches differ in half of the coordinates in which the texts do.
    differ = sum(F.bit_count(F.get("sketch", i).bitwiseXOR(F.get("other_sketch", i))) for i in range(SKETCH // 64))
    share = (1 - similarity) / 2
    most = SKETCH * share + SURE * (SKETCH * share * (1 - share)) ** 0.5
    return (
        viable.join(
            other,
            (F.col("band") == F.col("other_band"))
            & (F.col("node") < F.col("other_node"))
            & (F.col("label") != F.col("other_label"))
            & (bound(F.col("size"), F.col("common"), F.col("other_size"), F.col("other_common")) >= similarity)
            & (differ <= most)
            # The least band that both share owns the pair.
            & (F.array_min(F.array_intersect("bands", "other_bands")) == F.col("band")),
        )
        .select(F.col("node").alias("a"), F.col("other_node").alias("b"))
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, class_id, class_node, n_alike: one row per different text of `docs` (doc_id, text).

    node is xxhash64 of the text. A class is a component of texts linked by a weighted Jaccard
    similarity of at least `similarity`; class_id is its least doc_id (null only if all are
    null), n_alike the number of rows in it. Texts without words, null ones too, are alike only
    if equal; nulls are equal to each other and apart from the empty text. An empty table
    gives no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("node"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            n, keys = bands_of(part.column("text"))
            flat = pa.array(keys.reshape(-1))
            at = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32))
            flat = flat.filter(pa.array(np.repeat(n > 0, BANDS)))
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("doc_id"), pa.ListArray.from_arrays(at, flat)],
                ["node", "doc_id", "bands"],
            )

    signed = keyed.mapInArrow(run, "node long, doc_id long, bands array<long>")
    texts = written(
        signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands")),
        "near-texts",
    )
    banded = texts.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(banded.join(sizes, "band"), "near-bands")
    met = written(_hub_pairs(shared), "near-pairs")
    bodies = written(_bodies(keyed, texts.join(shared.select("node").distinct(), "node", "left_semi")), "near-bodies")
    links = written(_links(met, bodies, similarity), "near-links")
    labels = components(links)
    rest = _unmet_pairs(shared, labels, bodies, similarity).join(met, ["a", "b"], "left_anti")
    more = written(_links(rest, bodies, similarity), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    return _classes(texts, labels)


def _bodies(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """One text for each of the nodes."""
    wanted = ends.select("node", F.col("doc_id").alias("least_id"))
    return (
        keyed.join(wanted, "node").where(F.col("doc_id").eqNullSafe(F.col("least_id")))
        .groupBy("node").agg(F.first("text").alias("text"))
    )


def _classes(texts: DataFrame, labels: DataFrame) -> DataFrame:
    placed = texts.join(labels, "node", "left").select(
        "node", "doc_id", "n", F.coalesce("label", "node").alias("class_node")
    )
    classes = placed.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_alike"))
    return placed.select("node", "class_node").join(classes, "class_node").select("node", "class_id", "class_node", "n_alike")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_alike, kept: one row per row of `docs`.

    kept marks the rows with the least id of their class; exact repeats of such a row carry
    the mark too.
    """
    classes = near_duplicates(docs, similarity)
    return (
        docs.select("doc_id", F.xxhash64("text").alias("node")).join(classes, "node")
        .select("doc_id", "class_id", "n_alike", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the least doc_id, with the columns of `docs`."""
    classes = near_duplicates(docs, similarity)
    named = {"class_node": "__class", "class_id": "__least", "node": "__node"}
    classes = classes.select(*(F.col(a).alias(b) for a, b in named.items()))
    return (
        docs.withColumn("__node", F.xxhash64("text")).join(classes, "__node")
        .where(F.col("doc_id").eqNullSafe(F.col("__least")))
        .dropDuplicates(["__class"])
        .select(*docs.columns)
    )
