"""File inventories: hashes, companion files, unique pairs, manifest comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.sources.digests import long_file_digests

# --- fixed values: companions a layer file cannot do without ---------------------
REQUIRED_COMPANIONS = ("shp", "shx", "dbf")


def content_hashes(files: DataFrame) -> DataFrame:
    """path, sha256 and size of rows with path and content."""
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")
    )


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Hash of every file below a folder; Spark reads the files in parallel.

    Long files are read segment by segment, right away; a task holds no more than short ones.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    found = long_file_digests(spark, folder, pattern)
    if not found:
        return content_hashes(files)
    at = F.col("_metadata.file_path")
    rows = [(path, *told) for path, told in found.items()]
    told = spark.createDataFrame(rows, "at string, sha256 string, bytes long")
    paths = files.filter(at.isin(list(found))).select("path", at.alias("at"))
    long = paths.join(told, "at").select("path", "sha256", "bytes")
    return content_hashes(files.filter(~at.isin(list(found)))).unionByName(long)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def layer_component_check(files: DataFrame) -> DataFrame:
    """Companions missing per layer stem (package_id, path), as a list and a code."""
    stem = F.regexp_replace(F.col("path"), r"\.[^./]+$", "")
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1))
    required = F.array(*[F.lit(e) for e in REQUIRED_COMPANIONS])
    return (
        files.select("package_id", stem.alias("stem"), ext.alias("ext"))
        .groupBy("package_id", "stem")
        .agg(
            *[F.bool_or(F.col("ext") == e).alias(e) for e in REQUIRED_COMPANIONS],
            F.count("*").alias("files"),
        )
        .withColumn(
            "missing",
            F.filter(required, lambda e: ~F.coalesce(
                F.when(e == "shp", F.col("shp")).when(e == "shx", F.col("shx")).otherwise(F.col("dbf")),
                F.lit(False),
            )),
        )
        .select(
            "package_id",
            "stem",
            "files",
            "missing",
            F.when(F.size("missing") > 0, "MISSING_SHAPEFILE_COMPONENT").alias("code"),
        )
    )


def pick_unique_pair(files: DataFrame) -> DataFrame:
    """Exactly one elevation and one depth grid per package, else no choice is made."""
    stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]+$", "")
    is_grid = F.lower(F.col("path")).endswith(".tif")
    terrain = is_grid & stem.endswith("_Elevation")
    depth = is_grid & stem.endswith("_Depth")
    counted = files.groupBy("package_id").agg(
        F.count_if(terrain).alias("terrain_files"),
        F.count_if(depth).alias("depth_files"),
        F.min(F.when(terrain, F.col("path"))).alias("_t"),
        F.min(F.when(depth, F.col("path"))).alias("_d"),
    )
    unique = (F.col("terrain_files") == 1) & (F.col("depth_files") == 1)
    return counted.select(
        "package_id",
        "terrain_files",
        "depth_files",
        F.when(unique, F.col("_t")).alias("terrain_path"),
        F.when(unique, F.col("_d")).alias("depth_path"),
        F.when(~unique, "AMBIGUOUS_INPUT").alias("code"),
    )


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries that are missing, added or changed between two manifests.

    One full outer join on (package_id, path).
    """
    old = before.select("package_id", "path", F.col("sha256").alias("old_hash"))
    new = after.select("package_id", "path", F.col("sha256").alias("new_hash"))
    return (
        old.join(new, ["package_id", "path"], "full_outer")
        .withColumn(
            "state",
            F.expr(
                "CASE WHEN new_hash IS NULL THEN 'missing' WHEN old_hash IS NULL THEN 'added' "
                "WHEN old_hash != new_hash THEN 'changed' END"
            ),
        )
        .filter("state IS NOT NULL")
    )


def source_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per package: did its file set and hashes stay the same?"""
    changed = manifest_diff(before, after).groupBy("package_id").agg(F.count("*").alias("differences"))
    packages = before.select("package_id").unionByName(after.select("package_id")).distinct()
    return packages.join(changed, "package_id", "left").select(
        "package_id",
        F.coalesce("differences", F.lit(0)).cast("long").alias("differences"),
        F.when(F.col("differences") > 0, "SOURCE_CHANGED").alias("code"),
    )


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One digest per package over its path-sorted compact JSON of path to hash.

    Paths must be relative and unique and hashes 64 hex digits; a package with any bad
    entry gets a code and no digest. Entries go through in order of package and path and feed one
    running hash, so a package of any size takes the memory of one batch.
    """
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    rows = manifest.select("package_id", path.alias("path"), F.lower("sha256").alias("sha256"))
    bad = (
        F.col("path").startswith("/")
        | F.col("path").contains(":")
        | F.array_contains(F.split("path", "/"), "..")
        | ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
        | F.col("path").isNull()
    )
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("path").alias("p"))), r'^\{"p":(.*)\}$', 1)
    entries = (
        rows.groupBy("package_id", "path")
        .agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"), F.bool_or(bad).alias("bad"))
        .withColumn("entry", F.concat(quoted, F.lit(':"'), F.col("sha256"), F.lit('"')))
    )
    rows = entries.select("package_id", "path", "entry", (F.col("bad") | (F.col("n") > 1)).alias("bad"))
    ordered = rows.repartition("package_id").sortWithinPartitions("package_id", "path")
    kind = rows.schema["package_id"].dataType.simpleString()
    digests = ordered.mapInArrow(_running_digests, f"package_id {kind}, files long, bad boolean, digest string")
    return digests.select(
        "package_id",
        "files",
        F.when(~F.col("bad"), F.col("digest")).alias("digest"),
        F.when(F.col("bad"), "INVALID_SOURCE_MANIFEST").alias("code"),
    )


def _running_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per package out of entries that come in order; a package may go over many batches."""
    package = kind = digest = None
    files, bad = 0, False

    def told() -> pa.RecordBatch:
        digest.update(b"}")
        return pa.RecordBatch.from_arrays(
            [pa.array([package], kind), pa.array([files]), pa.array([bad]), pa.array([digest.hexdigest()])],
            ["package_id", "files", "bad", "digest"],
        )

    for batch in batches:
        kind = batch.column("package_id").type
        columns = (batch.column(c).to_pylist() for c in ("package_id", "entry", "bad"))
        for own, entry, spoiled in zip(*columns):
            if digest is None or own != package:
                if digest is not None:
                    yield told()
                package, files, bad, digest = own, 0, False, hashlib.sha256(b"{")
            digest.update((("," if files else "") + (entry or "")).encode())
            files, bad = files + 1, bad or bool(spoiled)
    if digest is not None:
        yield told()
