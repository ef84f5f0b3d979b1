"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document first gets the whole copies that its source's
target holds for sure; the words still missing are drawn by Pareto order sampling: documents
are ranked by random odds divided by inclusion odds, and the head of that ranking is taken
up to the missing words, so the sample's size is fixed while long documents are likelier. What
the head leaves open, the one document of the rest that fits it best closes.

Where the ranking is cut is found from sums over fine classes of the rank, so only one class
of each source is ever sorted, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.llm.frames import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Classes of the rank per source; only the class with the cut in it is sorted.
CLASSES = 4096
#: Sources up to which their targets are broadcast.
SHORT = 10_000
KEY = "xxhash64(doc_id, source, text)"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: place in code point order (null last), size, target in words.

    With the sources in the order of size over weight, the first k stop at their caps, where
    k is the least count for which the next one stays below its own; the rest share what
    remains by weight. The list of sources is the mix's configuration, as each has a weight
    of its own, so it is ranked in one place.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.col("source_size") * F.lit(most)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)))
        .withColumn("level", left / weight_left)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(whole))
        .withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap)))
        .select("source", "place", "source_size", "n", "target")
    )


def chance(doc_id: Column) -> Column:
    """A number in (0, 1) that the id alone decides."""
    text = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mixed(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, classes: int = CLASSES
) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies, taken: one row per row of `docs`.

    Needs doc_id, source and text. Null texts have size 0 and are never drawn beyond the whole
    copies; a null source is a source. Equal ids are drawn with equal chances, equal ranks are
    told apart by id, size and key, the xxhash64 of id, source and text. Of rows alike in all of
    these each is drawn for itself; which ones are is of no account. An empty table gives none.
    """
    sized = written(
        docs.select(
            "doc_id", "source", F.expr(KEY).alias("key"), word_count(F.col("text")).alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    goals = targets(sized, weights, share, most)
    ratio = F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))
    goals = (
        goals.withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("part", F.coalesce(F.col("missing") / F.col("source_size"), F.lit(0.0)))
    )
    goals = written(goals.withColumnRenamed("source", "of_source"), "mix-targets")
    # Tables with a row per source go to every task if they are short, and are joined otherwise;
    # else the rows of a large source would meet in one task for the sake of one row.
    short = goals.count() <= SHORT

    def per_source(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if short else rows

    u = chance(F.col("doc_id"))
    odds = (F.col("size") * F.col("n") / F.col("source_size")) * (F.col("part") / (1 - F.col("part")))
    ranked = (
        sized.join(per_source(goals), F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rank", F.when((F.col("size") > 0) & (F.col("part") > 0), (u / (1 - u)) / odds))
        .withColumn(
            "class",
            F.when(
                F.col("rank").isNotNull(),
                F.least(F.lit(classes - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * classes)),
            ).cast("int"),
        )
    )
    drawn = ranked.where("rank IS NOT NULL")
    upto = Window.partitionBy("place").orderBy("class")
    cuts = (
        drawn.groupBy("place", "class", "missing").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(upto))
        .where("upto > missing")
        .groupBy("place").agg(F.min_by(F.struct("class", (F.col("upto") - F.col("words")).alias("words")), "class").alias("cut"))
        .select(F.col("place").alias("cut_place"), F.col("cut.class").alias("cut_class"), F.col("cut.words").alias("cut_words"))
    )
    placed = ranked.join(per_source(cuts), F.col("place") == F.col("cut_place"), "left")
    sorted_class = F.coalesce(F.col("class") == F.col("cut_class"), F.lit(False))
    sure = placed.where(~sorted_class).withColumn(
        "extra",
        F.when(F.col("rank").isNull(), 0)
        .when(F.col("cut_class").isNull() | (F.col("class") < F.col("cut_class")), 1)
        .otherwise(0),
    )
    within = Window.partitionBy("place").orderBy("rank", "doc_id", "size", "key", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto_here = F.col("cut_words") + F.sum("size").over(within)
    at_cut = placed.where(sorted_class).withColumn("extra", F.when(upto_here <= F.col("missing"), 1).otherwise(0))
    drawn = written(sure.unionByName(at_cut), "mix-drawn")
    lacking = drawn.groupBy("place").agg(
        (F.first("missing") - F.sum(F.col("size") * F.col("extra"))).alias("lacking")
    )
    off = F.abs(F.col("size") - F.col("lacking"))
    closing = (
        drawn.where("extra = 0 AND rank IS NOT NULL").join(per_source(lacking), "place").where(off < F.col("lacking"))
        .groupBy("place")
        .agg(F.min_by("row", F.struct(off, "rank", "doc_id", "key", "row")).alias("last"))
        .select(F.col("place").alias("last_place"), "last")
    )
    is_last = (F.col("extra") == 0) & F.coalesce(F.col("row") == F.col("last"), F.lit(False))
    copies = F.col("whole") + F.col("extra") + F.when(is_last, 1).otherwise(0)
    return drawn.join(per_source(closing), F.col("place") == F.col("last_place"), "left").select(
        "doc_id", "source", "key", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row of `docs` as often as the mix takes it, with the columns of `docs`.

    Copies drawn for rows equal in id, source and text are spread over them as evenly as can be.
    Names that begin with two underscores are reserved.
    """
    taken = (
        mixed(docs, weights, share, most)
        .groupBy(F.col("key").alias("__key")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
        .where("__copies > 0")
    )
    found = docs.withColumn("__key", F.expr(KEY)).join(taken, "__key")
    even = found.where("__copies % __rows = 0").withColumn("__n", F.expr("int(__copies DIV __rows)"))
    # Rows are told apart only where the cut of a source falls among equal ones; in parts, as these may be many.
    uneven = written(
        found.where("__copies % __rows != 0").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(256))),
        "mix-equal",
    )
    before = Window.partitionBy("__key").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = uneven.groupBy("__key", "__salt").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__key", "__salt").orderBy(F.lit(0)))
    shared = (
        uneven.join(parts.drop("count"), ["__key", "__salt"]).withColumn("__number", number)
        .withColumn("__n", F.expr("int(__copies DIV __rows + if(__number <= __copies % __rows, 1, 0))"))
    )
    columns = [*docs.columns, "__n"]
    return (
        even.select(*columns).unionByName(shared.select(*columns))
        .select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__copy"))
        .select(*docs.columns)
    )
