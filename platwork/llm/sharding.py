"""Sharding by sampled splitters.

Rows are ordered by a key made of the text's hash and the id's, so equal texts stand next to
each other and yet a text that fills a third of the table still has many keys. Splitters are
weighted quantiles of a sample in which a row's chance grows with its size; ranges that turn
out overfull are sampled again and subdivided. Running sizes over the ranges and within each
range then give every row its exact place among all bytes, and with it its shard and slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.llm.frames import numbers, range_of, written

N_SHARDS = 16
#: Bytes that a range shall hold, ranges at least, sampled keys per range, and how often
#: overfull ranges are subdivided.
RANGE_BYTES = 256 << 20
LEAST_RANGES = 256
SAMPLES = 32
ROUNDS = 4


def text_key(text: Column, doc_id: Column) -> Column:
    """40 bits of the text's hash over 24 bits of the id's."""
    low = F.lit((1 << 24) - 1)
    return F.xxhash64(text).bitwiseAND(F.lit(~((1 << 24) - 1))).bitwiseOR(F.xxhash64(doc_id, text).bitwiseAND(low))


def splitters(
    df: DataFrame, key: str, size: str, n_ranges: int, samples: int = SAMPLES, rounds: int = ROUNDS
) -> list[int]:
    """Ascending bounds that cut the rows into about n_ranges ranges of equal summed size.

    About `samples` keys per range reach the driver. Rows with a null key are not sampled.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    if not total or n_ranges < 2:
        return []
    chance = F.xxhash64(F.col(key), F.lit("splitters")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    goal = total / n_ranges

    def quantiles(rows: DataFrame, parts: dict[int, tuple[float, int]], group: Column) -> set[int]:
        """Bounds that cut each group into the number of parts asked for; parts: size, count."""
        rate = samples / goal
        picked = rows.where(chance < F.col(size) * rate).select(group.alias("g"), key, size).toPandas()
        found: set[int] = set()
        for g, own in picked.groupby("g"):
            own = own.sort_values(key)
            weight = np.maximum(own[size].to_numpy(float) * rate, 1).cumsum()
            n = parts[int(g)][1]
            at = np.searchsorted(weight, weight[-1] * np.arange(1, n) / n)
            found |= {int(x) for x in own[key].to_numpy()[np.minimum(at, len(own) - 1)]}
        return found

    rows = df.where(F.col(key).isNotNull()).select(key, size)
    bounds = sorted(quantiles(rows, {0: (total, n_ranges)}, F.lit(0)))
    for _ in range(rounds):
        ranged = rows.withColumn("__range", range_of(F.col(key), bounds))
        heavy = ranged.groupBy("__range").agg(F.sum(size).alias("s"), F.min(key).alias("a"), F.max(key).alias("b"))
        over = {
            r["__range"]: (r["s"], int(r["s"] // goal) + 1)
            for r in heavy.where((F.col("s") > 2 * goal) & (F.col("a") < F.col("b"))).collect()
        }
        if not over:
            break
        chosen = F.array_contains(numbers(sorted(over)), F.col("__range").cast("long"))
        more = quantiles(ranged.where(chosen), over, F.col("__range")) - set(bounds)
        if not more:
            break
        bounds = sorted({*bounds, *more})
    return bounds


def shard_by_ranges(
    df: DataFrame,
    n_shards: int = N_SHARDS,
    range_bytes: int = RANGE_BYTES,
    least_ranges: int = LEAST_RANGES,
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows of `df` (with doc_id and text) with the columns in `keep` (all), size, shard, slot.

    size is the text's UTF-8 bytes plus 1, 1 for a null text. Shards hold equal parts of all
    bytes to within one row; slots count from 0 without gaps in each shard. Null ids are
    ordered first among equal texts; rows with equal id and text are interchangeable. Columns
    of the input named size, shard or slot are replaced. An empty table stays empty.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    keep = [c for c in (keep or df.columns) if c not in ("size", "shard", "slot")]
    keyed = df.withColumn("size", size).withColumn("__key", text_key(F.col("text"), F.col("doc_id")))
    keyed = keyed.select(*dict.fromkeys([*keep, "doc_id", "size", "__key"]))
    small = written(keyed.select("doc_id", "size", "__key"), "shard-keys")
    total = small.agg(F.sum("size")).first()[0] or 1
    bounds = splitters(small, "__key", "size", max(least_ranges, -(-total // range_bytes)))
    per_range = {
        r["__range"]: (r["s"], r["n"])
        for r in small.groupBy(range_of(F.col("__key"), bounds).alias("__range"))
        .agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        .collect()
    }
    sizes = [per_range.get(i, (0, 0)) for i in range(len(bounds) + 1)]
    bytes_before = numbers([0, *np.cumsum([s for s, _ in sizes]).tolist()])
    rows_before = numbers([0, *np.cumsum([n for _, n in sizes]).tolist()])

    def placed(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("__range").orderBy("__key", "doc_id", "size")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        return (
            rows.withColumn("__range", range_of(F.col("__key"), bounds))
            .withColumn("__at", F.get(bytes_before, F.col("__range")) + F.sum("size").over(upto) - F.col("size"))
            .withColumn("__row", F.get(rows_before, F.col("__range")) + F.row_number().over(order) - 1)
            .withColumn("shard", F.expr(f"CAST(__at * {n_shards} DIV {total} AS INT)"))
        )

    counts = {r["shard"]: r["count"] for r in placed(small).groupBy("shard").count().collect()}
    first = numbers([0, *np.cumsum([counts.get(s, 0) for s in range(n_shards)]).tolist()])
    return (
        placed(keyed)
        .withColumn("slot", F.col("__row") - F.get(first, F.col("shard")))
        .select(*keep, "size", "shard", "slot")
    )
