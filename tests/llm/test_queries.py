"""The registered queries over their whole tables: against SQL, or against brute force."""

import os
import zlib

import duckdb
import pytest

from platwork.llm import queries
from tests.llm import cases
from tools.check_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = db.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_shards(spark, texts):
    df = queries.QUERIES["op1_sampled_splitters"](spark, FOLDER)
    assert dict(df.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
        "shard": "int", "slot": "bigint", "grown_shard": "int",
    }
    rows = df.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert {r.shard for r in rows} == set(range(16))
    share = sum(r.size for r in rows) / 16
    for s in range(16):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - share) <= max(r.size for r in rows)


def test_near_duplicates(spark, texts):
    rows = queries.QUERIES["op4_dart_minhash"](spark, FOLDER).collect()
    ids = sorted(texts)
    want = dict(zip(ids, cases.near_classes([(i, texts[i]) for i in ids])))
    assert {r.doc_id: r.class_id for r in rows} == want
    assert {r.doc_id for r in rows if r.kept} == set(want.values())


@pytest.mark.parametrize("name, parts, rest", (("op3_random_fourier", 5, 0), ("op7_kneser_ney", 4, 2)))
def test_scores(spark, texts, name, parts, rest):
    df = queries.QUERIES[name](spark, FOLDER)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)


def test_transcripts(spark):
    rows = queries.QUERIES["op8_transcript_roles"](spark, FOLDER).collect()
    talk = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    role = {(r.conv_id, r.turn): r.role for r in talk}
    place = sorted(role)
    assert len(place) == len(talk) and all(place[r.line_no][0] == r.conv_id for r in rows)
    opened = [(place[r.line_no], r.role, r.held_out) for r in rows if r.i == 0]
    assert sum(role[at] == r for at, r, _ in opened) > 0.9 * len(opened) > 0.8 * len(role)
    assert all(held == (zlib.crc32(str(c).encode()) % 5 == 0) for (c, _), _, held in opened)
    for r in rows:
        assert r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>\n"
