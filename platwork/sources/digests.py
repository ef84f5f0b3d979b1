"""SHA-256 of long files: one task reads one segment and hands the half-made digest on.

A digest runs through its file from the first byte to the last, so the segments of one file come
after each other; those of different files are read at the same time.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------
SEGMENT = 128 << 20  # bytes of a file that a task reads; no longer files are read whole
PACKED = r"\.(gz|bz2|deflate|lz4|lzo|lzo_deflate|snappy|zst|xz|br|passthrough)$"  # the line reader unpacks these
MARK = b"\xef\xbb\xbf"  # the line reader leaves it out where a file begins with it
STATE = 112  # bytes of OpenSSL's SHA256_CTX


def long_file_digests(spark: SparkSession, folder: str, pattern: str) -> dict[str, tuple[str, int]]:
    """SHA-256 and size by `_metadata.file_path` of files beyond a segment.

    Spark reads them by lines, as only lines come in parts and byte by byte the same; line feeds are
    put back. A first pass over all segments at once measures them, a second hashes them in turn. A
    file whose lines do not add up to its size, or with one longer than a segment, is not in the answer.
    """
    if not resumable():
        return {}
    with _a_segment_a_task(spark):
        name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
        lines = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .text(folder, lineSep="\n")
            .filter((size > SEGMENT) & ~F.lower(name).rlike(PACKED))
        )
        path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        place = F.xxhash64(path, start).alias("place")
        keys = [F.spark_partition_id().alias("part"), path.alias("path"), size.alias("size"), start.alias("start"), place]
        measured = (
            lines.select(*keys, (F.octet_length("value") + F.lit(1)).alias("n"))
            .groupBy("part", "path", "size", "start", "place")
            .agg(F.sum("n").alias("n"), F.max("n").alias("longest"))
        )
        files: dict[str, list] = {}
        for row in sorted(measured.collect(), key=lambda row: row["start"]):
            files.setdefault(row["path"], []).append(row)
        # Lines tell no difference between a last line feed and none, the size does.
        around = {}
        for file, rows in files.items():
            missing = rows[0]["size"] + 1 - sum(row["n"] for row in rows)
            opening = MARK if missing >= len(MARK) else b""
            if missing - len(opening) in (0, 1) and max(row["longest"] for row in rows) <= SEGMENT:
                around[file] = opening, b"\n" * (missing - len(opening))
        whole = {file: files[file] for file in around}
        texts = lines.select(place, F.concat(F.lit(b"\n"), F.col("value").cast("binary")).alias("bytes"))
        states = _run(texts, whole, {file: _fed(_begun(), opening) for file, (opening, _) in around.items()})
        return {file: (_told(_fed(states[file], around[file][1])), rows[0]["size"]) for file, rows in whole.items()}


def _run(texts: DataFrame, files: dict[str, list], states: dict[str, bytes]) -> dict[str, bytes]:
    """State of each file's digest after its segments: a round takes the next one of every file."""
    states = dict(states)
    for turn in range(max(map(len, files.values()), default=0)):
        now = {file: rows[turn] for file, rows in files.items() if turn < len(rows)}
        given = {row["place"]: (row["start"] == 0, states[file], row["n"]) for file, row in now.items()}
        hashed = texts.mapInArrow(_segment_hasher(given), "place long, state binary").rdd
        told = dict(hashed.context.runJob(hashed, list, sorted(row["part"] for row in now.values())))
        states.update({file: bytes(told[row["place"]]) for file, row in now.items()})
    return states


def _segment_hasher(given: dict[int, tuple]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = _joined(batch.column("bytes"))
            if key is None:
                key = batch.column("place")[0].as_py()
                opens, state, left = given[key]
            if not pc.all(pc.equal(batch.column("place"), key)).as_py():
                break
            left -= data.size
            state = _fed(state, data.slice(1) if opens else data)
            opens = False
        if key is None or left:
            raise ValueError("SOURCE_CHANGED: a segment is not what was measured")
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state], pa.binary())], ["place", "state"])

    return run


def _joined(column: pa.Array) -> pa.Buffer:
    """The values of a column of bytes one after another, as they lie."""
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1]
    return data.slice(int(ends[0]), int(ends[-1] - ends[0]))


@contextmanager
def _a_segment_a_task(spark: SparkSession) -> Iterator[None]:
    """Spark cuts files into segments and puts no two into one task; its settings are put back."""
    wanted = {"maxPartitionBytes": SEGMENT, "openCostInBytes": SEGMENT, "maxPartitionNum": 2**31 - 1}
    wanted = {f"spark.sql.files.{name}": str(value) for name, value in wanted.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# --- a digest that can be handed on: the state of the OpenSSL behind hashlib, a plain struct -------


def _openssl() -> ctypes.CDLL:
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


def _begun() -> bytes:
    state = ctypes.create_string_buffer(STATE)
    _openssl().SHA256_Init(state)
    return state.raw


def _fed(state: bytes, data: bytes | pa.Buffer) -> bytes:
    held, data = ctypes.create_string_buffer(state, STATE), pa.py_buffer(data)
    _openssl().SHA256_Update(held, ctypes.c_void_p(data.address), ctypes.c_size_t(data.size))
    return held.raw


def _told(state: bytes) -> str:
    digest = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(digest, ctypes.create_string_buffer(state, STATE))
    return digest.raw.hex()


def resumable() -> bool:
    """Whether this Python's hashlib stands on an OpenSSL whose state can be handed on."""
    try:
        state = _fed(_fed(_begun(), b"a" * 70), b"b")
        return _told(state) == hashlib.sha256(b"a" * 70 + b"b").hexdigest()
    except (ImportError, OSError, AttributeError):
        return False
