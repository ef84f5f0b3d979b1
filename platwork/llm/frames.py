"""Small DataFrame helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.session import shared_folder


#: Whether Spark deletes the shuffle files of an execution when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, by: str | None = None, tidy: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors.

    With `tidy` the shuffle files that went into it are deleted once it stands; the session's setting
    for that is put back.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    if tidy:
        conf.set(TIDY, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if tidy:
            conf.unset(TIDY) if before is None else conf.set(TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table_: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing will read again."""
    folder = table_.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
        at = folder(path)
        at.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbers(values: list[int]) -> Column:
    """An array literal of whole numbers, folded to a constant by the optimiser."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most `key`, by binary search; null for null."""
    if not bounds:
        return F.when(key.isNotNull(), F.lit(0))
    table_ = numbers(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.when(
        key.isNotNull(),
        F.aggregate(
            steps,
            F.lit(0),
            lambda at, step: F.when(
                (at + step <= len(bounds)) & (F.get(table_, at + step - 1) <= key), at + step
            ).otherwise(at),
        ),
    )
