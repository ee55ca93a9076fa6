"""Shared folders, shipped files and text helpers for the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets an own one, and a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession, name: str, content: bytes) -> str:
    """Put bytes in the shared folder and register them as a file for the executors; SparkFiles.get finds it there.

    An executor that starts later fetches it anew, so lost executors do no harm.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'ship')}/{name}-{uuid.uuid4().hex}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for at in range(0, len(content), 1 << 22):
            out.write(bytearray(content[at : at + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(target.toString())
    return target.getName()


def ship_file(spark: SparkSession, path: str) -> str:
    """Register a local file of the driver (a tokenizer) for the executors; gives the name to ask SparkFiles for."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one blob that unpack() can map from a file without copying."""
    head, body, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 16)
        head.append(f"{name} {a.dtype.str} {len(a)} {at}")
        body.append(raw)
        at += len(raw)
    text = "\n".join(head).encode()
    first = len(text).to_bytes(8, "little") + text
    return first + b"\0" * (-len(first) % 16) + b"".join(body)


def unpack(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    start = (8 + n + 15) // 16 * 16
    out = {}
    for line in raw[8 : 8 + n].tobytes().decode().split("\n"):
        name, kind, size, at = line.split(" ")
        dtype = np.dtype(kind)
        out[name] = raw[start + int(at) : start + int(at) + int(size) * dtype.itemsize].view(dtype)
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, and of so many bytes of strings unless a single row has more: a Python worker's memory is bounded by both."""
    for batch in batches:
        width = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                width += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(width), 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
            n = max(1, min(rows, fits - at))
            yield batch.slice(at, n)
            at += n


def buffers(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column as all its bytes and the cuts between rows, without copying; null as empty."""
    column = batch.column(name).cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8), cuts - cuts[0]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def semi_join(df: DataFrame, keys: DataFrame, name: str, rows: int = 200_000) -> DataFrame:
    """Rows of df whose key is among keys: broadcast while keys are at most so many rows, else shuffled."""
    keys = keys.select(name)
    return df.join(F.broadcast(keys) if small_enough(keys, rows) else keys, name, "left_semi")


def as_doc_text(df: DataFrame) -> DataFrame:
    """doc_id as long and text as string, whatever else df holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def put_file(uri: str, content: bytes) -> None:
    """Write a file into the shared folder from a task: whole or not at all, so a repeated task does no harm."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, path)


def map_file(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file in the shared folder, memory-mapped: in place where the folder is mounted, else from one copy an executor."""
    from pyarrow import fs
    from pyspark import SparkFiles

    store, path = fs.FileSystem.from_uri(uri)
    if store.type_name == "local":
        return unpack(path)
    own = os.path.join(SparkFiles.getRootDirectory(), path.strip("/").replace("/", "_"))
    if not os.path.exists(own):
        part = f"{own}.{uuid.uuid4().hex}"
        with store.open_input_stream(path) as source, open(part, "wb") as target:
            while data := source.read(1 << 22):
                target.write(data)
        os.replace(part, own)
    return unpack(own)
