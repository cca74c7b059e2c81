"""Partition files: 32-byte big-endian frames, each before its payload, as a table; and a partitioned sink.

A frame holds map id (4 bytes), attempt id (8), sequence id (4), offset (8) and length (8).  Sequence id -1
marks a checksum: no payload follows and the length field holds the checksum.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import BLOCKS_SQL, FRAMES_SQL, blocks, frames
from ..declare import query
from ..storage import new_path

FRAME = struct.Struct(">iqiqq")
SCHEMA = "map_id int, attempt_id long, seq_id int, offset long, length long, data binary"


WRITTEN = ("partition_id", "map_id", "attempt_id", "seq_id", "data")


def decode_stream(file: IO[bytes]) -> Iterator[tuple]:
    """(map_id, attempt_id, seq_id, offset, length, data) of every frame; a cut-off file is an error."""
    at = 0
    while head := file.read(FRAME.size):
        if len(head) < FRAME.size:
            raise ValueError(f"frame cut off at byte {at}")
        map_id, attempt_id, seq_id, offset, length = FRAME.unpack(head)
        at += FRAME.size
        data = None
        if seq_id != -1:
            data = file.read(length)
            if len(data) < length:
                raise ValueError(f"payload cut off at byte {at}")
            at += length
        yield map_id, attempt_id, seq_id, offset, length, data


def decode(content: bytes) -> Iterator[tuple]:
    return decode_stream(io.BytesIO(content))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["map_id", "attempt_id", "seq_id", "offset", "length", "data"])


def _big_endian(value: Column, size: int) -> Column:
    text = F.hex(value.cast("long"))
    return F.unhex(F.right(F.lpad(text, 16, "0"), F.lit(2 * size)))


def frame(map_id: Column, attempt_id: Column, seq_id: Column, offset: Column, length: Column) -> Column:
    return F.concat(_big_endian(map_id, 4), _big_endian(attempt_id, 8), _big_endian(seq_id, 4), _big_endian(offset, 8), _big_endian(length, 8))


def scan(files: DataFrame) -> DataFrame:
    """Frames of files given as (path, content), such as the ``binaryFile`` source has, on any file system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _batch(list(decode(content or b"")))
                yield pa.RecordBatch.from_arrays([pa.array([path] * found.num_rows, pa.string()), *found.columns], names=["path", *found.schema.names])

    return files.select("path", "content").mapInArrow(run, f"path string, {SCHEMA}")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it: local, HDFS and object stores by their scheme."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


PENDING, READY, FINAL = ".dat", ".dat_final", "final"
#: Bytes of payloads given on at once.
BATCH_BYTES = 4 << 20


def _files(path: str) -> tuple[fs.FileSystem, list[str], list[str]]:
    """Pending and ready partition files at or below a path."""
    store, root = opened(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return store, [], [root]
    named = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.base_name.startswith("shuffle_")]
    return store, sorted(f for f in named if f.endswith(PENDING)), sorted(f for f in named if f.endswith(READY))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    STEP = 0.3

    def __init__(self, path: str, wait: float | None) -> None:
        self.path, self.wait = path, wait

    def partitions(self) -> list[_File]:
        """S8 told to wait, all files are read once none is pending any more; one that stays so for too long is an
        error.  Otherwise those that are final now are read."""
        until = time.monotonic() + (self.wait or 0)
        while True:
            _, pending, ready = _files(self.path)
            if not pending or self.wait is None:
                return [_File(f) for f in ready]
            if time.monotonic() >= until:
                raise TimeoutError(f"{len(pending)} files still pending, such as {pending[0]}")
            time.sleep(self.STEP)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """One file, frame by frame: no more than a batch of it is held."""
        store, _ = opened(self.path)
        with store.open_input_stream(partition.path) as file:
            rows, held = [], 0
            for row in decode_stream(file):
                rows.append(row)
                held += FRAME.size + len(row[5] or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """S1-S4 rows (partition_id, map_id, attempt_id, seq_id, data) of a task into one file per run of a partition."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.id = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = opened(self.path)
        task = uuid.uuid4().hex[:12]
        files: list[str] = []
        out, at, offset, sums = None, None, 0, {}

        def closed() -> None:
            for (map_id, attempt_id), total in sorted(sums.items()):  # S2: no payload, so the offset stays
                out.write(FRAME.pack(map_id, attempt_id, -1, offset, total))
            out.close()

        try:
            for batch in iterator:
                for partition, map_id, attempt_id, seq_id, data in zip(*(batch.column(c).to_pylist() for c in WRITTEN), strict=True):
                    if partition != at or out is None:
                        if out is not None:
                            closed()
                        at, offset, sums = partition, 0, {}
                        store.create_dir(f"{root}/{partition}", recursive=True)
                        files.append(f"{root}/{partition}/shuffle_{self.id}-{task}-{len(files)}_0_{partition}{PENDING}")
                        out = store.open_output_stream(files[-1])
                    data = data or b""
                    out.write(FRAME.pack(map_id, attempt_id, seq_id, offset, len(data)))
                    out.write(data)
                    offset += FRAME.size + len(data)
                    sums[map_id, attempt_id] = sums.get((map_id, attempt_id), 0) + zlib.crc32(data)
            if out is not None:
                closed()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """S3 files of the tasks that count are renamed to final; those of attempts that were lost are deleted."""
        store, pending, ready = _files(self.path)
        kept = {f for m in messages if m is not None for f in m.files}
        for path in kept:
            folder, name = path.rsplit("/", 1)
            store.create_dir(f"{folder}/{FINAL}", recursive=True)
            store.move(path, f"{folder}/{FINAL}/{name.removesuffix(PENDING)}{READY}")
        self._drop(store, [f for f in pending if f not in kept and self.id in f])
        self._drop(store, ready if self.overwrite else [])

    def abort(self, messages: list[_Written | None]) -> None:
        """S4 nothing of this write stays."""
        store, pending, ready = _files(self.path)
        self._drop(store, [f for f in pending + ready if self.id in f])

    @staticmethod
    def _drop(store: fs.FileSystem, files: list[str]) -> None:
        for path in files:
            store.delete_file(path)


class FramedSource(DataSource):
    """``spark.read.format("framed").load(path)``: final partition files at or below a path (S5, E4); with the
    option ``wait``, only once no file is pending, for which it waits so many seconds at most.

    ``df.write.format("framed").mode("append").save(path)``: rows with the columns ``WRITTEN``, a null payload being
    empty.  Cluster them by ``partition_id`` first: a task begins a file whenever the partition changes."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], float(self.options["wait"]) if "wait" in self.options else None)

    def writer(self, schema, overwrite: bool) -> _Writer:
        missing = [c for c in WRITTEN if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        return _Writer(self.options["path"], overwrite)


def stored_frames(rows: DataFrame) -> DataFrame:
    """Blocks written as partition files to the shared folder, committed, and read back from there (S1-S3, S5)."""
    spark = rows.sparkSession
    spark.dataSource.register(FramedSource)
    path = new_path(spark, "frames")
    sent = rows.select("partition_id", F.col("map_id").cast("int"), F.lit(0).cast("long").alias("attempt_id"), F.col("seq_id").cast("int"), F.col("data").cast("binary").alias("data"))
    sent.repartition("partition_id").sortWithinPartitions("partition_id", "map_id", "seq_id").write.format("framed").mode("append").save(path)
    return spark.read.format("framed").load(path)


def crc_verified(frames: DataFrame) -> DataFrame:
    """(map_id, blocks, bytes, status) of frames read: the checksums that came with a map's blocks (S2) against those of
    the bytes that were read (I3)."""
    data = F.col("seq_id") >= 0
    sums = frames.groupBy("map_id").agg(
        F.count_if(data).alias("blocks"),
        F.coalesce(F.sum(F.when(data, F.col("length"))), F.lit(0)).alias("bytes"),
        F.sum(F.when(~data, F.col("length"))).alias("stored"),
        F.coalesce(F.sum(F.when(data, F.crc32("data"))), F.lit(0)).alias("read"),
    )
    status = F.when(F.col("stored").isNull(), "MISSING_INDEX").when(F.col("stored") != F.col("read"), "MISMATCH").otherwise("OK")
    return sums.select("map_id", "blocks", "bytes", status.alias("status"))


@query(f"""WITH {BLOCKS_SQL} SELECT map_id::INTEGER AS map_id, seq_id::INTEGER AS seq_id, length, md5(data) AS digest FROM blocks""")
def framed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S5, C3, D9 blocks written as frames to storage and read back."""
    return stored_frames(blocks(spark, sf_dir)).where("seq_id >= 0").select("map_id", "seq_id", "length", F.md5("data").alias("digest"))


@query(f"""WITH {BLOCKS_SQL} SELECT map_id::INTEGER AS map_id, count(*) AS blocks, sum(length)::BIGINT AS bytes, 'OK' AS status FROM blocks GROUP BY map_id""")
def stored_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, A6, I1, I3, C1 checksum frames written beside the blocks, held against the crc32 of the bytes read back."""
    return crc_verified(stored_frames(blocks(spark, sf_dir)))


@query(f"WITH {FRAMES_SQL} SELECT partition_id, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM frames WHERE partition_id < 6 GROUP BY ALL")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 output grouped by partition on disk; a reader of some partitions opens only their folders."""
    path = new_path(spark, "partitioned")
    frames(spark, sf_dir).select("partition_id", "l_orderkey").repartition("partition_id").write.partitionBy("partition_id").parquet(path)
    back = spark.read.schema("l_orderkey long, partition_id long").parquet(path)
    return back.where("partition_id < 6").groupBy("partition_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
