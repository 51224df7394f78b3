"""The versioned block container as a data source: spark.read.format("fqz"), df.write.format("fqz").

Reading plans one partition for each block by hopping over block headers and gives arrow batches. Spark passes a Python source the schema
it was asked for by ``schema()``, not a query's columns: ``read_container(columns=...)`` names them, and streams of others are not unpacked.
Writing: each task encodes its blocks to a file of its own beside the target, commit joins them in block order and renames; a failed job leaves nothing.
Paths must be open to Python on driver and executors (a mounted file system); elsewhere use the Parquet archive.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import kernels

BATCH = 20_000
SCHEMA = "block_idx long, record_idx long, header binary, sequence binary, plus binary, quality binary"


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def block_headers(path: str) -> tuple[tuple[int, int, int, int], list[dict]]:
    """The file header, and each block's header with its offset and first record; reads no payload."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = kernels.parse_file_header(f.read(kernels.FILE_HEAD.size))
        out, first = [], 0
        at = kernels.FILE_HEAD.size
        while at < size:
            f.seek(at)
            b = kernels.parse_block_header(f.read(kernels.BLOCK_HEAD[head[0]].size), head[0])
            length = kernels.BLOCK_HEAD[head[0]].size + b["payload"]
            if at + length > size:
                raise ValueError("truncated block")
            out.append(b | {"at": at, "length": length, "first": first, "block_idx": len(out)})
            at, first = at + length, first + b["num_records"]
    return head, out


@dataclass
class _Block(InputPartition):
    at: int
    length: int
    first: int
    block_idx: int
    version: int
    offset: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[_Block]:
        (version, _, _, offset), blocks = block_headers(self.path)
        return [_Block(b["at"], b["length"], b["first"], b["block_idx"], version, offset) for b in blocks]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with open(self.path, "rb") as f:
            f.seek(partition.at)
            data = f.read(partition.length)
        n, found = kernels.decode_columns(data, partition.version, partition.offset, self.names)
        for lo in range(0, n, BATCH):
            hi = min(n, lo + BATCH)
            ids = {"block_idx": lambda: pa.array([partition.block_idx] * (hi - lo), pa.int64()), "record_idx": lambda: pa.array(range(partition.first + lo, partition.first + hi), pa.int64())}
            yield pa.RecordBatch.from_arrays([ids[c]() if c in ids else pa.array(found[c][lo:hi], pa.binary()) for c in self.names], self.names)


@dataclass
class _Written(WriterCommitMessage):
    parts: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, offset: int, block_records: int, version: int, flags: int):
        self.path, self.offset, self.block_records, self.version, self.flags = path, offset, block_records, version, flags
        self.work = f"{path}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        parts, block, held = [], None, []

        def flush() -> None:
            cols = [[v for h in held for v in h.column(c).cast(pa.binary()).to_pylist()] for c in ("header", "sequence", "plus", "quality")]
            os.makedirs(self.work, exist_ok=True)
            name = f"{self.work}/{block:012d}-{uuid.uuid4().hex}"
            with open(name, "wb") as f:
                f.write(kernels.encode_block(*cols, self.offset, self.version))
            parts.append((block, name))

        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block_idx")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and blocks[lo] != block:
                    flush()
                    held = []
                block = int(blocks[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            flush()
        return _Written(parts)

    def commit(self, messages: list) -> None:
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        if len({b for b, _ in parts}) != len(parts):
            self.abort(messages)
            raise ValueError("rows of a block must come in one task, together")
        with open(f"{self.path}.tmp", "wb") as out:
            out.write(kernels.file_header(self.offset, self.block_records, self.version, self.flags))
            for _, name in parts:
                with open(name, "rb") as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
        os.replace(f"{self.path}.tmp", self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.work):
            for name in os.listdir(self.work):
                os.remove(f"{self.work}/{name}")
            os.rmdir(self.work)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fqz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_local(self.options["path"]), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_local(self.options["path"]), int(self.options.get("offset", "33")), int(self.options.get("blockRecords", "100000")), int(self.options.get("version", "2")), int(self.options.get("flags", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
