import gzip
import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from platwork.operators import contracts as oc
from platwork.operators import coordinates as co
from platwork.operators import network as on
from platwork.plans import reports as pr
from platwork.session import new_folder
from platwork.sources import digests as dg
from platwork.sources import features as sf
from platwork.sources import files as fl
from platwork.sources import sinks as sk
from platwork.sources import strict_json as sj
from platwork.sources import wkb as sw
from tests import shapes as sh


def test_wkb_roundtrip_and_bad_bytes(spark):
    shapes = {
        "box": sh.box(0, 0, 2, 2),
        "z": sh.box(0, 0, 2, 2, has_z=True),
        "line": sh.line((0, 0), (1, 2), (3, 4)),
        "point": sh.point(5, 6),
        "many": ("polygon", False, [sh.box(0, 0, 1, 1)[2][0], sh.box(3, 3, 4, 4)[2][0]]),
        "empty": ("polygon", False, []),
        "null": None,
    }
    source = sh.records(spark, shapes)
    back = sw.decode_wkb(sw.with_wkb(source).drop("geom")).collect()
    want = {r.source_record_id: r.geom for r in source.collect()}
    assert {r.source_record_id: r.geom for r in back} == want
    assert all(r.readable for r in back)
    big_endian = struct.pack(">BIIIdddddddd", 0, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)
    raw = [
        ("be", big_endian),
        ("cut", big_endian[:30]),
        ("type", struct.pack("<BI", 1, 99)),
        ("none", b""),
        ("nan_z", struct.pack("<BIddd", 1, 1001, 1.0, 2.0, float("nan"))),
        ("trailing", big_endian + b"x"),
    ]
    rows = sw.decode_wkb(spark.createDataFrame(raw, "id string, wkb binary")).collect()
    flags = {r.id: (r.readable, r.finite_z) for r in rows}
    assert flags["be"] == (True, True) and flags["nan_z"] == (True, False)
    assert not any(flags[k][0] for k in ("cut", "type", "none", "trailing"))


def test_geojson_files(spark, tmp_path):
    features = [
        {"type": "Feature", "id": "a", "properties": {"k": "v"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {
            "type": "Feature", "id": "b", "properties": None,
            "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 0, 1]]]]},
        },
        {"type": "Feature", "id": "c", "properties": {}, "geometry": None},
        {"type": "Feature", "id": "d", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 2]]}},
    ]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {r.feature_id: r for r in sf.read_geojson(spark, str(tmp_path), "EPSG:32631").collect()}
    assert rows["a"].geom.kind == "point" and rows["a"].props == {"k": "v"}
    assert rows["b"].geom.has_z and rows["b"].geom.kind == "polygon"
    assert rows["c"].code == "INVALID_WATER_GEOMETRY"
    assert len(rows["d"].geom.parts[0][0]) == 2
    with pytest.raises(ValueError, match="EXPLICIT_GEOJSON_CRS_REQUIRED"):
        sf.read_geojson(spark, str(tmp_path), None)


def test_manifest_of_real_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "sub" / "b.bin").write_bytes(b"two")
    rows = fl.file_manifest(spark, str(tmp_path)).collect()
    assert {r.sha256 for r in rows} == {hashlib.sha256(t).hexdigest() for t in (b"one", b"two")}


def test_manifest_of_long_files_goes_by_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dg, "SEGMENT", 5_000)
    noise = random.Random(7)
    odd = {
        "noise.bin": noise.randbytes(40_000),
        "sub/ends with feed [a]%20{b}.parquet": noise.randbytes(23_456) + b"\n",
        "feeds.bin": b"\n" * 17_001,
        "marked.csv": b"\xef\xbb\xbf" + b"a,\xff\r\n" * 4_000,
        "marked_open.csv": b"\xef\xbb\xbf\n" + noise.randbytes(12_345) + b"x",
        "one_line.bin": b"\x00" * 31_000,
        "segment.bin": noise.randbytes(4_999) + b"\n" + noise.randbytes(5_000),
        "packed.txt.gz": gzip.compress(noise.randbytes(20_000)),
        "falsely.bz2": noise.randbytes(9_000),
        "short.bin": noise.randbytes(5_000),
    }
    for name, content in odd.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    settings = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    rows = fl.file_manifest(spark, str(tmp_path)).collect()
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert sorted(rows) == sorted(fl.content_hashes(plain).collect())
    assert sorted((r.sha256, r.bytes) for r in rows) == sorted((hashlib.sha256(c).hexdigest(), len(c)) for c in odd.values())
    # Only short files, packed ones and lines longer than a segment are read whole.
    found = dg.long_file_digests(spark, str(tmp_path), "*")
    whole = ("short.bin", "packed.txt.gz", "falsely.bz2", "one_line.bin")
    assert sorted(n for _, n in found.values()) == sorted(len(c) for k, c in odd.items() if k not in whole)
    assert settings == {k: spark.conf.get(k) for k in settings}


def test_manifest_of_file_the_reader_refuses_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dg, "SEGMENT", 1_000_000)
    content = random.Random(3).randbytes(3_333_333)
    (tmp_path / "long.parquet").write_bytes(content)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000000")
    try:
        rows = fl.file_manifest(spark, str(tmp_path), "*.parquet").collect()
    finally:
        spark.conf.unset(limit)
    assert [(r.sha256, r.bytes) for r in rows] == [(hashlib.sha256(content).hexdigest(), len(content))]


def test_manifest_digest_is_canonical(spark):
    digest = "AB" * 32
    rows = [(1, "b\\c.txt", digest), (1, "a.txt", digest.lower()), (2, "../x", digest), (3, "a", "12"), (4, "a", digest), (4, "a", digest)]
    out = {r.package_id: r for r in fl.manifest_digest(spark.createDataFrame(rows, "package_id int, path string, sha256 string")).collect()}
    text = json.dumps({"a.txt": digest.lower(), "b/c.txt": digest.lower()}, sort_keys=True, separators=(",", ":"))
    assert out[1].digest == hashlib.sha256(text.encode()).hexdigest()
    assert all(out[k].code == "INVALID_SOURCE_MANIFEST" for k in (2, 3, 4))


def test_manifest_digest_runs_over_many_batches(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("CAST(NULL AS int) AS package_id", "concat('d/', id) AS path", "sha2(string(id), 256) AS sha256")
    out = fl.manifest_digest(rows.unionByName(rows.limit(3).withColumn("package_id", F.lit(1)))).collect()
    found = {r.package_id: r for r in out}
    entries = {f"d/{i}": hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)}
    text = json.dumps(dict(sorted(entries.items(), key=lambda e: e[0].encode())), separators=(",", ":"))
    assert found[None].files == n and found[None].digest == hashlib.sha256(text.encode()).hexdigest()
    assert found[1].files == 3


def test_publish_once_and_apart(spark, tmp_path):
    source = tmp_path / "raw" / "in.parquet"
    source.parent.mkdir()
    source.write_text("x")
    table = spark.range(10).withColumn("tile_row", F.col("id") % 2)
    target = str(tmp_path / "out" / "pkg")
    manifest = sk.publish_new(spark, {"terrain": table}, target, [str(source)])
    assert manifest.count() >= 2 and spark.read.parquet(f"{target}/terrain").count() == 10
    assert not list((tmp_path / "out").glob("*staging*"))
    assert sk.published(spark, target, "terrain").count() == 10
    # Half a package, as a store leaves it that renames file by file.
    table.write.parquet(str(tmp_path / "half" / "terrain"))
    with pytest.raises(ValueError, match="PACKAGE_NOT_COMMITTED"):
        sk.published(spark, str(tmp_path / "half"), "terrain")
    with pytest.raises(ValueError, match="OUTPUT_EXISTS"):
        sk._commit(spark, target)
    with pytest.raises(ValueError, match="OUTPUT_EXISTS"):
        sk.publish_new(spark, {"terrain": table}, target, [str(source)])
    with pytest.raises(ValueError, match="OUTPUT_IN_SOURCE_DIRECTORY"):
        sk.publish_new(spark, {"terrain": table}, str(tmp_path / "raw" / "pkg"), [str(source)])


def test_zone_document_roundtrip(spark):
    from platwork.model import GEOMETRY

    zones = spark.createDataFrame(
        [("p", "z1", sh.box(0, 0, 100, 100), "residential", 120.0, 180.0, True, {"trip_rate": 2.0})],
        f"package_id string, zone_id string, geom {GEOMETRY}, land_use string, block_w double, block_h double, "
        "allow_demolition boolean, overrides map<string,double>",
    )
    documents = sk.zones_to_json(zones).withColumn("row_id", F.lit(1))
    good, bad = sj.import_zones(documents)
    row = good.first()
    assert bad.count() == 0 and row.geom == zones.first().geom
    assert (row.block_w, row.block_h, row.allow_demolition, row.overrides) == (120.0, 180.0, True, {"trip_rate": 2.0})


def test_scenario_precedence_and_lock(spark):
    zones = spark.createDataFrame(
        [("p", "a", "residential", {"t": 3.0}), ("p", "b", "residential", None), ("p", "c", "office", None),
         ("p", "d", "office", {"t": 1.0}), ("p", "e", "transport", None), ("p", "f", "residential", {"x": 1.0})],
        "package_id string, zone_id string, land_use string, overrides map<string,double>",
    )
    schema = "package_id string, land_use string, name string, value double"
    system = spark.createDataFrame([("p", u, "t", 1.0) for u in ("residential", "office")], schema)
    user = spark.createDataFrame([("p", "residential", "t", 2.0)], schema)
    values, rejects = oc.resolve_scenario(zones, system, user)
    assert {r.zone_id: r.value for r in values.collect()} == {"a": 3.0, "b": 2.0, "c": 1.0}
    assert {r.zone_id: r.code for r in rejects.collect()} == {
        "d": "SCENARIO_LOCKED", "e": "MISSING_DEFAULTS", "f": "UNKNOWN_PARAMETER",
    }


def test_known_transverse_mercator_values(spark):
    rows = [("a", 0.0, 0.0), ("b", 3.0, 45.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double").selectExpr(
        "*", "'EPSG:4326' AS source_crs", "'EPSG:32631' AS target_crs"
    )
    out = {r.id: (r.tx, r.ty) for r in co.reproject_vertices(df).collect()}
    assert out["a"] == pytest.approx((166021.4431, 0.0), abs=1e-3)
    assert out["b"] == pytest.approx((500000.0, 4982950.4002), abs=1e-3)


def test_foot_plane_roundtrip(spark):
    df = spark.createDataFrame([(-80.5, 26.0)], "x double, y double").selectExpr(
        "*", "'EPSG:4269' AS source_crs", "'EPSG:2236' AS target_crs"
    )
    row = co.reproject_vertices(df).first()
    assert row.tx > 656166 and row.transform_code is None


def test_game_plane(spark):
    mapping = spark.createDataFrame(
        [("p", 100.0, 200.0, 2.0, 2.0)], "package_id string, e0 double, n0 double, half_x double, half_z double"
    )
    points = spark.createDataFrame(
        [("p", 1.0, 80.0, -1.0, False), ("p", 2.1, 0.0, 0.0, False), ("p", 0.0, 0.0, 0.0, True)],
        "package_id string, gx double, gh double, gz double, for_export boolean",
    )
    rows = co.game_forward(points, mapping).collect()
    assert (rows[0].east, rows[0].north, rows[0].height) == (101.0, 199.0, 80.0)
    assert [r.code for r in rows] == [None, "OUTSIDE_SOURCE_COVERAGE", "UNCONFIRMED_GAME_MAPPING"]
    back = spark.createDataFrame([("p", 99.0, 202.0, -10.0, False)], "package_id string, east double, north double, height double, for_export boolean")
    row = co.game_inverse(back, mapping).first()
    assert (row.gx, row.gh, row.gz) == (-1.0, -10.0, 2.0)


def test_mapping_roundtrip_and_corner_cells(spark):
    grids = sh.grids(spark, ("terrain", 4, 4, 1, 98, 202), ("depth", 2, 2, 2, 98, 202))
    mapping = co.mapping_from_grids(grids)
    row = mapping.first()
    assert (row.e0, row.n0, row.half_x, row.half_z, row.code) == (100.0, 200.0, 2.0, 2.0, None)
    audit = co.roundtrip_audit(mapping).first()
    assert audit.roundtrip_points == 27 and audit.passed
    corner = co.corner_cells(grids, mapping).filter("row = 0 AND col = 0").first()
    assert (corner.gx, corner.gh, corner.gz) == (-1.5, 0.0, 1.5)


def test_readiness_of_a_full_package(spark):
    profile = spark.createDataFrame(
        [(1, 16, 8, True, 0, 0, 0), (2, 16, 8, True, 1, 0, 3)],
        "package_id int, terrain_valid int, depth_valid int, conserved boolean, terrain_missing int, depth_outside int, unknown int",
    )
    facts = spark.createDataFrame(
        [(1, True, True, "m", "game_origin", True)],
        "package_id int, carto_source_confirmed boolean, complete_depth_coverage_confirmed boolean, terrain_unit string, "
        "terrain_vertical_reference string, game_mapping_confirmed boolean",
    )
    rows = {r.package_id: r for r in pr.readiness(profile, facts).collect()}
    assert rows[1].planning_ready and rows[1].blocking == []
    assert rows[2].blocking == [
        "TERRAIN_MISSING", "CARTO_SOURCE_UNCONFIRMED", "DEPTH_COVERAGE_UNCONFIRMED", "LAND_WATER_UNKNOWN",
        "TERRAIN_UNIT_UNCONFIRMED", "VERTICAL_REFERENCE_UNCONFIRMED", "GAME_MAPPING_UNCONFIRMED",
    ]


def test_shortest_path(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (0, 2, 10.0), (9, 0, 1.0)], "src long, dst long, weight double")
    rows = {r.node: r for r in on.shortest_paths(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert rows[2].distance == 5.0 and rows[2].predecessor == 1 and 9 not in rows


def test_snap_and_totals(spark):
    nodes = spark.createDataFrame([("p", 0, 0.0, 0.0), ("p", 1, 10.0, 10.0)], "package_id string, node_id int, x double, y double")
    points = spark.createDataFrame([("p", 7, 1.0, 1.0), ("p", 8, 900.0, -880.0)], "package_id string, point_id int, x double, y double")
    rows = {r.point_id: r.node_id for r in on.snap_nearest(points, nodes).collect()}
    assert rows == {7: 0, 8: 1}
    trips = spark.createDataFrame([(0, 2, 100.0)], "origin int, destination int, trips double")
    assert on.od_totals(trips).filter("origin IS NULL").first().trips == 100.0


def test_scratch_folder_is_fresh(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_texts_that_are_no_collection_keep_a_row(spark):
    from platwork.sources.features import parse_collections

    feature = '{"type":"Feature","id":"f","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}'
    texts = {
        "good": '{"type":"FeatureCollection","features":[' + feature + "]}",
        "cut": '{"type":"FeatureCollection","features":[' + feature[:20],
        "none": '{"type":"FeatureCollection"}',
        "bare": feature,
        "empty": '{"type":"FeatureCollection","features":[]}',
    }
    frame = spark.createDataFrame(list(texts.items()), "collection_id string, text string")
    rows = {r.collection_id: r for r in parse_collections(frame, "EPSG:4326").collect()}
    assert {k: r.code for k, r in rows.items()} == {
        "good": None, "cut": "INVALID_FEATURE_COLLECTION", "none": "INVALID_FEATURE_COLLECTION",
        "bare": "INVALID_FEATURE_COLLECTION", "empty": None,
    }
    assert rows["good"].geom is not None and rows["empty"].position is None


def test_deeply_nested_bytes_are_one_bad_record(spark):
    nested = b"\x01\x07\x00\x00\x00\x01\x00\x00\x00" * 5000 + b"\x01\x01\x00\x00\x00" + b"\x00" * 16
    sound = b"\x01\x01\x00\x00\x00" + b"\x00" * 16
    rows = spark.createDataFrame([("deep", nested), ("point", sound)], "source_record_id string, wkb binary")
    found = {r.source_record_id: r for r in sw.decode_wkb(rows).collect()}
    assert not found["deep"].readable and found["deep"].geom is None
    assert found["point"].readable and found["point"].geom.kind == "point"
