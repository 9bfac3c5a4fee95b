"""Landed page bodies as a data source: gzip files named by their snapshot reference.

A task writes its bodies and one list of their references; the commit names the lists of all tasks.
What is not named by a commit is not there, so a write that fails or runs twice shows nothing twice.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.basics import first_reason

FORMAT = "landed_bodies"
#: Bytes of bodies from which on a reader sends what it holds, so that a task's memory does not grow with its rows.
BATCH_BYTES = 4 << 20
SCHEMA = "ref string, body binary, sha256 string"
#: What went wrong before there was a response, by words of the error's text. Fixed values are the kinds.
TRANSPORT = {"timeout": "timed? ?out|timeout", "dns": "name or service|name resolution|getaddrinfo|nodename", "tls": "ssl|tls|certificate", "proxy": "proxy", "connection": "connect|reset|refused|unreachable|broken pipe"}


@dataclass
class _Listed(InputPartition):
    """A task's list of references."""

    name: str


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    bodies: int
    size: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, local or an object store, and the folder's path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _write(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as source:
        return source.read()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))], ["ref", "body", "sha256"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
        lists = [name for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json") for name in json.loads(_read(store, f.path))["lists"]]
        return [_Listed(name) for name in dict.fromkeys(lists)]

    def read(self, partition: _Listed | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was ever committed
            return
        store, root = _opened(self.path)
        rows, size = [], 0
        for ref in _read(store, f"{root}/_lists/{partition.name}").decode().split("\n"):
            if ref:
                body = gzip.decompress(_read(store, f"{root}/{ref}"))
                rows.append((ref, body, hashlib.sha256(body).hexdigest()))
                size += len(body)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/_lists", recursive=True)
        refs, size = [], 0
        for batch in iterator:
            for ref, body in zip(batch.column("ref"), batch.column("body")):
                if not ref.is_valid or not body.is_valid:
                    continue
                packed = gzip.compress(body.as_py(), mtime=0)
                _write(store, f"{root}/{ref.as_py()}", packed)
                refs.append(ref.as_py())
                size += len(packed)
        name = f"{uuid.uuid4().hex}.txt" if refs else None
        if name:
            _write(store, f"{root}/_lists/{name}", "\n".join(refs).encode())
        return _Written(name, len(refs), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/_commits", recursive=True)
        done = [m for m in messages if m is not None]
        told = {"lists": [m.name for m in done if m.name], "bodies": sum(m.bodies for m in done), "bytes": sum(m.size for m in done)}
        _write(store, f"{root}/_commits/{uuid.uuid4().hex}.json", json.dumps(told).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/_lists/{m.name}")


class LandedBodies(DataSource):
    """``spark.read.format("landed_bodies").load(folder)`` and the writer to it.

    Rows are (ref, body, sha256); when written, rows without a reference or a body are left out and
    the digest is not needed. A partition is what one task wrote. Writing appends.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("landed bodies are only ever added")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedBodies)


def land(bodies: DataFrame, folder: str) -> None:
    """Adds bodies (ref, body) to a folder."""
    register(bodies.sparkSession)
    bodies.select("ref", F.col("body").cast("binary").alias("body"), F.lit(None).cast("string").alias("sha256")).write.format(FORMAT).mode("append").save(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All committed bodies of a folder; a reference that was written more than once is one row."""
    register(spark)
    return spark.read.format(FORMAT).load(folder).dropDuplicates(["ref"])


def transport_kind(error: Column) -> Column:
    """timeout, dns, tls, proxy or connection, from the text of an error; connection if nothing fits, null for null."""
    text = F.lower(error)
    return F.when(error.isNotNull(), F.coalesce(first_reason([(kind, text.rlike(words)) for kind, words in TRANSPORT.items()]), F.lit("connection")))


def responses(requests: DataFrame, bodies: DataFrame) -> DataFrame:
    """What requests (url, ref, error and more columns) got: ``status``, ``body``, ``sha256``, ``transport``.

    A status is data: 200 with the landed body, 404 where none is landed. A request with an error
    never had a response: its status is null and ``transport`` names the kind.
    """
    joined = requests.join(bodies.select("ref", "body", "sha256"), "ref", "left")
    failed = F.col("error").isNotNull()
    hidden = {c: F.when(~failed, F.col(c)) for c in ("body", "sha256")}
    return joined.withColumns(hidden | {"status": F.when(failed, None).when(F.col("body").isNull(), 404).otherwise(200), "transport": transport_kind(F.col("error"))})
