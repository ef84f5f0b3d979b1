"""Work that grows with the tables: what must not be gathered, repeated or dealt to one task."""

import math

from pyspark.sql import functions as F

from platwork import fixtures as fx
from platwork.model import GEOMETRY
from platwork.operators import conflicts as oc
from platwork.operators import network as on
from platwork.operators import quality as oq
from platwork.operators.pairs import bbox_pairs, outlined, shape_pairs
from platwork.registry import package_queries as pq
from platwork.streaming import jobs as st
from tests import shapes as sh


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_rows_in_bins_are_never_gathered(spark, capsys):
    lines = spark.createDataFrame(
        [("p", "c", sh.line((0, 0), (4, 0)), 1.0)], f"package_id string, corridor_id string, geom {GEOMETRY}, radius double"
    )
    areas = spark.createDataFrame(
        [("p", "near", sh.box(1, 0.5, 2, 2)), ("p", "far", sh.box(1, 5, 2, 6))],
        f"package_id string, area_id string, geom {GEOMETRY}",
    )
    met = oc.protection_conflicts(lines, areas)
    assert [r.area_id for r in met.collect()] == ["near"]
    boxes = spark.createDataFrame([("p", (0.0, 0.0, 1.0, 1.0))], "package_id string, a_box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    pairs = bbox_pairs(boxes, boxes.withColumnRenamed("a_box", "b_box"), "a_box", "b_box")
    assert pairs.count() == 1
    for df in (met, pairs):
        plan = plan_of(df, capsys)
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_records_of_few_edges_need_no_bins_however_long(spark):
    wide = 1e13
    twisted = sh.polygon([(0, 0), (wide, 4), (wide, 0), (0, 4), (0, 0)])
    rows = oq.with_validity(sh.records(spark, {"box": sh.box(0, 0, wide, 2), "twisted": twisted}))
    assert {r.source_record_id: r.is_valid for r in rows.collect()} == {"box": True, "twisted": False}


def test_points_in_one_place_are_snapped_once(spark, capsys):
    nodes = spark.createDataFrame([("p", 5, 0.0, 0.0), ("p", 3, 2.0, 0.0)], "package_id string, node_id int, x double, y double")
    places = [("p", n, 1.0, 0.0) for n in range(50)] + [("p", 7, 0.0, 0.0), ("p", 60, None, 0.0)]
    snapped = on.snap_nearest(spark.createDataFrame(places, "package_id string, point_id int, x double, y double"), nodes)
    rows = {r.point_id: (r.node_id, r.distance_sq) for r in snapped.collect()}
    assert rows == {**{n: (3, 1.0) for n in range(50)}, 7: (5, 0.0)}
    windows = [row for row in plan_of(snapped, capsys).splitlines() if "Window" in row]
    assert windows and not any("point_id" in row for row in windows)


def test_rows_of_small_files_are_dealt_before_they_grow(spark, capsys, tmp_path):
    spark.range(10).selectExpr("id AS p_partkey", "int(id) AS p_size", "double(id) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    assert "hashpartitioning(p_partkey" in plan_of(fx.objects(spark, str(tmp_path)), capsys)


def _circle(x, y, radius, n):
    ring = [(x + radius * math.cos(2 * math.pi * i / n), y + radius * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return sh.polygon([*ring, ring[0]])


def test_short_shapes_meet_in_one_row_and_long_ones_edge_by_edge(spark, capsys):
    """Pairs of short shapes have their edges spelled out after the join, and give what long ones do."""
    def lines(shapes):
        rows = [("p", name, geom, 0.5) for name, geom in shapes.items()]
        return spark.createDataFrame(rows, f"package_id string, corridor_id string, geom {GEOMETRY}, radius double")

    def areas(shapes):
        rows = [("p", name, geom) for name, geom in shapes.items()]
        return spark.createDataFrame(rows, f"package_id string, area_id string, geom {GEOMETRY}")

    short = {"short": sh.line((0, 0), (9, 0)), "inside": sh.line((20, 20), (20.25, 20.25)), "off": sh.line((0, 3.75), (9, 3.75))}
    long = {"long": sh.line(*((i / 4, 0) for i in range(37)))}
    few = {"box": sh.box(2, 0.5, 3, 2), "wide": sh.box(15, 15, 25, 25), "near": sh.box(12, 0.75, 13, 2)}
    many = {"ring": _circle(5, -1.5, 1, 64), "round": _circle(20, 20, 4, 64)}
    expected = {
        ("short", "box"), ("short", "ring"), ("long", "box"), ("long", "ring"), ("inside", "wide"), ("inside", "round"),
    }
    met = oc.protection_conflicts(lines({**short, **long}), areas({**few, **many}))
    assert sorted((r.corridor_id, r.area_id) for r in met.collect()) == sorted(expected)
    met = oc.protection_conflicts(lines(short), areas(few))
    assert sorted((r.corridor_id, r.area_id) for r in met.collect()) == [("inside", "wide"), ("short", "box")]
    # The edges of both sides are spelled out above the join, so no more than the shapes is shuffled.
    above, below = plan_of(met.select("*"), capsys).split("SortMergeJoin", 1)
    assert "inline(" in above and "inline(" not in below
    shapes = areas({**few, **many}).withColumnRenamed("area_id", "b")
    both = shape_pairs(outlined(shapes.withColumnRenamed("b", "a"), ["package_id", "a"], "a"), outlined(shapes, ["package_id", "b"], "b"), "a", "b", ["package_id", "a", "b"])
    found = {(r.a, r.b): r.common_area for r in both.collect()}
    round_ = 64 / 2 * 16 * math.sin(2 * math.pi / 64)
    assert set(found) == {(n, n) for n in (*few, *many)} | {("wide", "round"), ("round", "wide")}
    assert abs(found["wide", "round"] - round_) < 1e-9 and abs(found["box", "box"] - 1.5) < 1e-9


def test_packages_are_classified_once_for_all_outputs(spark, capsys, monkeypatch):
    given = {}
    monkeypatch.setattr(pq.sk, "publish_new", lambda spark, tables, *_: given.update(tables))
    pq._published(spark, "/root/testdata/sf0.001")
    assert set(given) == {"terrain", "class_mask", "water_extent"}
    for table in given.values():
        assert "Join" not in plan_of(table, capsys) and table.count()


def test_dealt_rows_keep_their_number_of_parts_and_grow_after_it(spark, capsys, tmp_path):
    """Few MB would be put together again, and filters on shapes worked out where the file is read."""
    spark.range(10).selectExpr("id AS p_partkey", "int(id) AS p_size", "double(id) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    plan = plan_of(fx.objects(spark, str(tmp_path)).filter("geom.parts[0][0][1].x > 1"), capsys)
    above, below = plan.split("REPARTITION_BY_NUM", 1)
    assert "Filter (" in above and "Filter (" not in below


def _odd_records(spark):
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    shell = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)]
    touching = [(2, 2), (3, 2), (3, 3), (2, 3), (2, 2)]
    closing = [(2, 1), (3, 1), (3, 2), (2, 1)]
    rings = {
        "box": [shell],
        "bowtie": [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]],
        "spike": [[(0, 0), (2, 0), (2, 2), (1, 1), (2, 2), (0, 2), (0, 0)]],
        "collapsed": [[(0, 0), (1, 1), (1, 2), (1, 1), (0, 0)]],
        "repeated": [[(0, 0), (0, 0), (4, 0), (4, 4), (0, 0)]],
        "crossed hole": [shell, [(5, 5), (7, 5), (7, 5.5), (5, 5.5), (5, 5)]],
        "hole": [shell, hole],
        "two holes in touch": [shell, hole, touching],
        "loop of holes": [shell, hole, touching, closing],
        "thirds": [[(0, 0), (3, 1), (0, 1), (3, 0), (1, 2), (0, 0)]],
    }
    geoms = {name: ("polygon", False, [[[(float(x), float(y)) for x, y in r] for r in rs]]) for name, rs in rings.items()}
    geoms |= {"none": None, "empty": ("polygon", False, []), "line": sh.line((0, 0), (4, 4), (4, 0), (0, 4))}
    geoms["two"] = ("polygon", False, geoms["box"][2] + sh.box(5, 5, 7, 7)[2])
    return sh.records(spark, geoms)


def test_short_records_are_told_in_their_row_as_by_the_join_of_edges(spark, monkeypatch):
    import platwork.operators.batches as ob

    records = _odd_records(spark).cache()
    joined = {r.source_record_id for r in oq._faulty_records(records).collect()}
    assert {"bowtie", "spike", "crossed hole", "loop of holes"} <= joined and not {"box", "two holes in touch"} & joined
    wanted = {(r.source_record_id, r.start, r.end, r.drawn) for r in oq._nodes_in_bins(records).collect()}
    for bound in (ob.AT_ONCE, 1):
        monkeypatch.setattr(ob, "AT_ONCE", bound)
        rows = records.toArrow()
        names, parts = rows["source_record_id"].to_pylist(), rows["geom"].combine_chunks().field("parts")
        polygon = {r.source_record_id for r in records.filter("geom.kind = 'polygon'").collect()}
        assert {n for n, bad in zip(names, ob.faulty(parts).to_pylist()) if bad and n in polygon} == joined
    found = {(r.source_record_id, r.start, r.end, r.drawn) for r in oq.segment_nodes(records).collect()}
    assert found == wanted and {r[0] for r in found} >= {"line", "two", "bowtie"}
    twice = {(r.source_record_id, r.start, r.end, r.drawn) for r in oq.segment_nodes(records.unionByName(records)).collect()}
    assert twice == wanted


def test_short_records_are_judged_without_a_shuffle_and_noded_with_one(spark, capsys):
    records = sh.records(spark, {"box": sh.box(0, 0, 1, 1)})
    plan = plan_of(oq.with_validity(records), capsys)
    assert "faulty(" in plan.split("Union", 1)[1].split("Join", 1)[0]
    assert "Exchange" not in plan.split("Union", 1)[1].split("Join", 1)[0]
    nodes = plan_of(oq.segment_nodes(records), capsys).split("Union", 1)[1].split("Window", 1)[0]
    assert "noded(" in nodes and nodes.split("noded(")[0].count("Exchange") == 1


def test_a_review_judges_its_records_once(spark, capsys):
    review = oq.repair_review(oq.with_validity(_odd_records(spark)))
    assert "faulty(" not in plan_of(review, capsys)
    status = {r.source_record_id: r.status for r in review.collect()}
    assert status["bowtie"] == "POLYGON_CANDIDATE" and status["empty"] == "UNSUPPORTED_REVIEW" and "box" not in status


def test_pairs_of_short_shapes_are_told_in_one_row(spark, capsys):
    shapes = {
        "wide": sh.box(0, 0, 8, 8), "inside": sh.box(2, 2, 3, 3), "corner": sh.box(8, 8, 9, 9), "side": sh.box(8, 2, 9, 4), "apart": sh.box(20, 0, 21, 1),
        "ring": sh.polygon([(1, 1), (7, 1), (4, 6), (1, 1)]), "line": sh.line((-1, 4), (9, 4)),
    }

    def outlines(side):
        rows = spark.createDataFrame([("p", n, g) for n, g in shapes.items()], f"package_id string, {side} string, geom {GEOMETRY}")
        return outlined(rows, ["package_id", side], side)

    keys = ["package_id", "a", "b"]
    pairs = shape_pairs(outlines("a"), outlines("b"), "a", "b", keys, with_form=True)
    plan = plan_of(pairs, capsys)
    assert "MapInArrow" in plan and "inline(" not in plan
    found = {(r.a, r.b): (r.common_area, r.along) for r in pairs.collect()}
    assert found["wide", "inside"] == (1.0, False) and found["wide", "corner"] == (0.0, False) and found["wide", "side"] == (0.0, True)
    assert found["wide", "ring"] == (15.0, False) and found["ring", "line"] == (0.0, False)
    assert not any("apart" in names for names in found if names != ("apart", "apart"))
    # The same out of single edges.
    lefts, rights = outlines("a").withColumn("a_whole", F.lit(False)), outlines("b")
    single = shape_pairs(lefts, rights, "a", "b", keys, with_form=True)
    assert {(r.a, r.b): (r.common_area, r.along) for r in single.collect()} == found
    assert {(r.a, r.b) for r in shape_pairs(outlines("a"), rights, "a", "b", keys, False, ordered=True).collect()} == {n for n in found if n[0] < n[1]}


def test_a_batch_of_requests_is_read_once_and_named_by_short_numbers(spark, capsys, tmp_path):
    inbox, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("p", f"c{n % 3}", n % 4) for n in range(12)], "package_id string, corridor_id string, kind int").write.parquet(inbox)

    def decide(batch):
        seen.append((plan_of(batch, capsys), {r.corridor_id for r in batch.collect()}))
        return batch.selectExpr("package_id", "corridor_id", "kind AS answer")

    stream = spark.readStream.schema("package_id string, corridor_id string, kind int").parquet(inbox)
    out = st.decide_stream(stream, decide, str(tmp_path / "run"))
    assert {(r.corridor_id, r.answer) for r in st.answers(spark, out).collect()} == {(f"c{n % 3}", n % 4) for n in range(12)}
    plan, names = seen[0]
    assert len(names) == 12 and all(n.isdigit() for n in names)
    assert "Aggregate" not in plan and "Exchange" not in plan and "sha2" not in plan
