"""Helpers shared by the corpus operators: tables, shared staging, text chunks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside binary id lists; sorts after every other id.
NO_ID = np.iinfo(np.int64).max
CHUNK = "chunk long, ids binary, ends binary, attrs binary, text binary"
#: Rows a written file should hold at least, where a table's rows are counted: of a few numbers each, or of whole texts.
SLIM_ROWS, WIDE_ROWS = 1 << 15, 1 << 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a local session gets a new temporary folder; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def gathered(df: DataFrame, rows: int, per: int = SLIM_ROWS) -> DataFrame:
    """`df`, which has about `rows` rows, in as few partitions as leave each about `per`; never in more than it has.

    Adaptive execution does so where it may. Where it may not, each round of a loop would write a small
    table as hundreds of files, and a local folder costs the writing JVM several processes a file.
    """
    return df.coalesce(max(1, -(-rows // per)))


class Scratch:
    """Tables written to the shared folder during one operator call.

    A written table survives lost executors and cuts the lineage. `drop` frees a table that
    nothing reads any more; a table that the returned DataFrame reads has to stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, per: int = SLIM_ROWS) -> DataFrame:
        """`df` as a written table. `rows`, where they are about known, bound the number of its files."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = gathered(df, rows, per)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Free all tables of this call, once its result lies elsewhere."""
        self.drop("")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others may clash and are left out."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def batches(schema: pa.Schema, rows: Iterator[tuple], per: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `per` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= per:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty; the values are not decoded."""
    col = batch.column(name).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """`text` in parts of about `size` bytes that end at ASCII white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def chunk_docs(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of about `chunk_bytes` of whole texts: ids and texts packed and compressed.

    `docs` has doc_id, text and attrs (a string carried along, or null). Inside a chunk the
    documents are ordered by id. A text longer than the chunk is a chunk of its own.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("attrs", pa.binary()), ("text", pa.binary())])
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in held], np.int64)
            ends = np.cumsum([len(r[1]) for r in held]).astype(np.int64)
            pack = zstandard.ZstdCompressor(level=3).compress
            attrs = [r[2] or b"" for r in held]
            sizes = np.array([len(a) for a in attrs], np.int64).tobytes()
            row = (number, ids.tobytes(), ends.tobytes(), pack(sizes + b"".join(attrs)), pack(b"".join(r[1] for r in held)))
            return next(batches(schema, iter([row])))

        for frame in frames:
            ids = frame.column("doc_id").fill_null(NO_ID).to_pylist()
            for row in zip(ids, texts(frame), frame.column("attrs").cast(pa.binary()).to_pylist()):
                held.append(row)
                size += len(row[1])
                if size >= chunk_bytes or len(held) >= 65_536:
                    yield packed()
                    number, held, size = number + 1, [], 0
        if held:
            yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("attrs").cast("string").alias("attrs"))
    return rows.mapInArrow(run, CHUNK)


def unpack(ids: bytes, ends: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Ids, start and end offsets, and the joined texts of a chunk."""
    stop = np.frombuffer(ends, np.int64)
    start = np.concatenate([np.zeros(1, np.int64), stop[:-1]])
    return np.frombuffer(ids, np.int64), start, stop, zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(stop[-1])))


def unpack_attrs(data: bytes, n: int) -> list[str | None]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw[: 8 * n], np.int64)
    ends = np.cumsum(sizes) + 8 * n
    return [raw[e - s : e].decode() if s else None for s, e in zip(sizes.tolist(), ends.tolist())]


def outer_id(ids: np.ndarray) -> list[int | None]:
    return [None if i == NO_ID else i for i in ids.tolist()]
