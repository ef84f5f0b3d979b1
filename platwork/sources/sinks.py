"""Outputs: zone documents, and derived packages that appear once and complete."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.sources.files import file_manifest


def zones_to_json(zones: DataFrame) -> DataFrame:
    """One JSON document per zone: a single identity, its geometry and permissions."""
    polygon = "transform(geom.parts, p -> transform(p, r -> transform(r, v -> array(v.x, v.y))))"
    geometry = (
        f"CASE WHEN size(geom.parts) = 1 "
        f"THEN concat('{{\"type\":\"Polygon\",\"coordinates\":', to_json({polygon}[0]), '}}') "
        f"ELSE concat('{{\"type\":\"MultiPolygon\",\"coordinates\":', to_json({polygon}), '}}') END"
    )
    rest = (
        "to_json(named_struct('zone_id', zone_id, 'land_use', land_use, "
        "'block_size_m', array(block_w, block_h), 'allow_demolition', allow_demolition, "
        "'scenario_overrides', overrides))"
    )
    return zones.selectExpr(
        "package_id",
        "zone_id",
        f"concat('{{\"geometry\":', {geometry}, ',', substring({rest}, 2)) AS raw",
    )


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def check_destination(spark: SparkSession, destination: str, source_paths: list[str]) -> None:
    """A derived package is new, and stays outside every source folder."""
    files, target = _path(spark, destination)
    if files.exists(target):
        raise ValueError("OUTPUT_EXISTS: create a new package, never overwrite one")
    for source in source_paths:
        folder = _path(spark, source)[1].getParent().toString().rstrip("/")
        wanted = target.toString().rstrip("/")
        if wanted == folder or wanted.startswith(folder + "/"):
            raise ValueError("OUTPUT_IN_SOURCE_DIRECTORY: keep derived data apart from sources")


def publish_new(
    spark: SparkSession, tables: dict[str, DataFrame], destination: str, source_paths: list[str]
) -> DataFrame:
    """Write tables into a new package folder that becomes visible in one step.

    All tables go to a staging folder beside the destination, with a manifest of their
    files; the folder is then renamed, and a commit record is put into it, which fails if
    there is one. Where a store renames folders file by file, the record still comes last,
    so readers that ask for it (`published`) never see half a package. Returns the manifest.
    """
    check_destination(spark, destination, source_paths)
    staging = f"{destination.rstrip('/')}_staging_{uuid.uuid4().hex}"
    for name, table in tables.items():
        # One folder per package and tile row, each written by one task.
        parts = [c for c in ("package_id", "tile_row") if "tile_row" in table.columns and c in table.columns]
        writer = (table.repartition(*parts) if parts else table).write.mode("errorifexists")
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(f"{staging}/{name}")
    package_manifest(spark, staging).write.mode("errorifexists").json(f"{staging}/manifest")
    files, source = _path(spark, staging)
    _, target = _path(spark, destination)
    if files.exists(target) or not files.rename(source, target):
        raise ValueError("OUTPUT_EXISTS: output changed while it was written")
    _commit(spark, destination)
    return spark.read.json(f"{destination.rstrip('/')}/manifest")


COMMITTED = "_COMMITTED"


def _commit(spark: SparkSession, destination: str) -> None:
    files, record = _path(spark, f"{destination.rstrip('/')}/{COMMITTED}")
    try:
        out = files.create(record, False)
    except Py4JJavaError as error:
        raise ValueError("OUTPUT_EXISTS: another writer committed this package") from error
    out.write(bytearray(b"committed"))
    out.close()


def published(spark: SparkSession, destination: str, table: str) -> DataFrame:
    """A table of a committed package; a package without a commit record is refused."""
    files, record = _path(spark, f"{destination.rstrip('/')}/{COMMITTED}")
    if not files.exists(record):
        raise ValueError("PACKAGE_NOT_COMMITTED: no such package, or one that is still being written")
    return spark.read.parquet(f"{destination.rstrip('/')}/{table}")


def package_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Artifact, relative path, hash and size of every data file of a package."""
    relative = F.regexp_replace("path", r"^.*?\Q" + folder.rstrip("/").split("/")[-1] + r"/\E", "")
    return (
        file_manifest(spark, folder, "*.parquet")
        .withColumn("path", relative)
        .withColumn("artifact", F.element_at(F.split("path", "/"), 1))
    )


def terrain_and_mask(classes: DataFrame) -> dict[str, DataFrame]:
    """The three outputs of water normalisation, cut by tile row.

    `classes` has package_id, row, col, height_m (NaN where missing), class, tile_row.
    """
    keys = ["package_id", "row", "col"]
    return {
        "terrain": classes.select(*keys, "height_m", "tile_row"),
        "class_mask": classes.select(*keys, F.col("class").cast("tinyint").alias("class"), "tile_row"),
        "water_extent": classes.filter("class = 2").select(*keys, "tile_row"),
    }
