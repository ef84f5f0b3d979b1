"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from platwork.streaming import jobs as st
from tools.check_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "ag2_class_accounting",
    "jn2_resample_bilinear",
    "w3_window_roi_compare",
    "jn6_zone_association",
    "d1_decide_conflicts",
    "q4_repair_review",
    "sp7_union_coverage_clip",
    "src4_wkb_decode",
    "src8_strict_json_zones",
    "g7_declaration_reconciliation",
    "jn12_snap_nearest",
    "gr1_shortest_path",
    "st1_stream_decisions",
    "st2_stream_profile",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_every_query_but_the_folder_scan_has_a_twin():
    from platwork.registry.catalog import QUERIES

    assert set(QUERIES) - set(entry.oracle_sql()) == {"src5_file_manifest_of_folder"}


def test_stream_answers_a_repeated_request_once(spark, tmp_path):
    from platwork import fixtures as fx
    from platwork.plans import decisions as pd

    inbox = tmp_path / "in"
    events = fx.table(spark, FOLDER, "events").limit(50)
    repeated = events.unionByName(events.limit(10))
    repeated.coalesce(1).write.parquet(str(inbox))
    requests = fx.corridors_of(st.event_stream(spark, str(inbox), "*.parquet"), "ts")
    tables = (
        fx.objects(spark, FOLDER),
        fx.zones(spark, FOLDER),
        fx.protected(spark, FOLDER),
        fx.snapshot_header(spark, FOLDER),
    )
    out = st.decide_stream(
        requests, lambda batch: pd.decide_conflicts(batch.drop("ts"), *tables), str(tmp_path / "run")
    )
    batch = pd.decide_conflicts(fx.corridors_of(events), *tables)
    stream = st.answers(spark, out)
    assert stream.count() == 50
    assert stream.exceptAll(batch).count() == 0


@pytest.mark.parametrize("files", (1, 7))
def test_stream_answers_late_requests_however_files_fall(spark, tmp_path, files):
    from pyspark.sql import functions as F

    from platwork import fixtures as fx
    from platwork.plans import decisions as pd

    inbox = tmp_path / "in"
    events = fx.table(spark, FOLDER, "events").limit(30)
    late = events.limit(3).withColumn("event_id", F.col("event_id") + 10**6).withColumn(
        "ts", F.col("ts") - F.expr("INTERVAL 60 DAYS")
    )
    for i in range(files):
        events.filter(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(str(inbox))
    late.coalesce(1).write.mode("append").parquet(str(inbox))
    requests = fx.corridors_of(
        st.event_stream(spark, str(inbox), "*.parquet"), "ts"
    )
    tables = (
        fx.objects(spark, FOLDER), fx.zones(spark, FOLDER), fx.protected(spark, FOLDER),
        fx.snapshot_header(spark, FOLDER),
    )
    out = st.decide_stream(
        requests, lambda batch: pd.decide_conflicts(batch.drop("ts"), *tables), str(tmp_path / "run")
    )
    assert st.answers(spark, out).count() == 33


@pytest.mark.parametrize("batches", (1, 2))
def test_stream_answers_different_requests_under_one_id(spark, tmp_path, batches):
    from pyspark.sql import functions as F

    from platwork import fixtures as fx
    from platwork.plans import decisions as pd

    inbox, run = tmp_path / "in", str(tmp_path / "run")
    tables = (
        fx.objects(spark, FOLDER), fx.zones(spark, FOLDER), fx.protected(spark, FOLDER),
        fx.snapshot_header(spark, FOLDER),
    )
    own = pd.decide_conflicts(fx.corridors_of(fx.table(spark, FOLDER, "events").limit(200)), *tables)
    sent = fx.corridors_of(fx.table(spark, FOLDER, "events").limit(200), "ts").cache()
    live = own.where("status <> 'stale_input'").orderBy("corridor_id").first()
    one = sent.where((F.col("corridor_id") == live.corridor_id) & (F.col("package_id") == live.package_id))
    other = one.withColumn("asset_modes", F.array(F.lit("nothing"))).withColumn("requested_mode", F.lit("nothing"))
    nameless = sent.limit(3).withColumn("corridor_id", F.lit(None).cast("string"))
    parts = [one.unionByName(nameless), other.unionByName(one.withColumn("ts", F.expr("ts + INTERVAL 1 HOUR")))]
    if batches == 1:
        parts = [parts[0].unionByName(parts[1])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(sent.schema).option("pathGlobFilter", "*.parquet").parquet(str(inbox))
        out = st.decide_stream(stream, lambda batch: pd.decide_conflicts(batch.drop("ts"), *tables), run)
    found = st.answers(spark, out)
    want = [pd.decide_conflicts(x.drop("ts"), *tables) for x in (one, other)]
    for verdict in want:
        assert verdict.count() == 1 and verdict.exceptAll(found).count() == 0
    assert found.where("corridor_id IS NULL").count() == 3 and found.count() == 5
    assert st.answers(spark, out, keyed=True).select("request").distinct().count() == 5
