"""Shared helpers: the shared folder, table access, hashing of words, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor sees.

    A directory given to setCheckpointDir counts too. Only on one machine (a local master, as in
    tests) a temporary folder stands in; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="meshwright-"))
            atexit.register(_drop_own)
        base = f"file://{_made[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drop_own() -> None:
    import shutil

    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def write_read(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back: cuts lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    return write_read(df, shared_folder(df.sparkSession, name))


class Workspace:
    """Intermediate tables of one operator in one shared folder, removed together when it is done.

    Used as a context: what the caller returns must be written elsewhere before it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, shared_folder(spark, name), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        return write_read(df, f"{self.root}/{self.made:03d}-{name}")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_exc: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def sized(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df in as many partitions as so many rows need, without a shuffle; never more than it has."""
    return df.coalesce(max(1, -(-rows // each)))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path inside it; plain paths are local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in batches of at most so many rows.

    Only ever lowers the session's setting, to bound memory; no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each value, without building str objects."""
    return column.cast(pa.binary()).to_pylist()


def fold_of(column: str = "doc_id"):
    """crc32(doc_id as text) mod 5, as a column; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(0))


class WordHashes(dict):
    """word bytes -> 64-bit hash, kept between batches and emptied when it grows too large."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > self.limit:
            self.clear()
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
