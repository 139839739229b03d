"""Shared helpers: durable intermediate tables, worker imports, words, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers

#: One word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; tokenizers and numpy take one thread there."""
    env = spark.sparkContext.environment
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    workers.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share. A local master may do without, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{given.rstrip('/')}/matchforge-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and
    a lost executor costs nothing of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``durable`` that no later DataFrame reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``durable`` made in this application; DataFrames that read them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def row_key(id_col: Column, text: Column) -> Column:
    """128 bits naming a row by id and text, so that null ids and repeated ids stay apart."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("null")), text.isNull().cast("string"), F.coalesce(text, F.lit("")))))


#: A worker remembers the hashes of at most so many words.
REMEMBERED = 300_000


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text; bytes.split() cuts at exactly space and 9 to 13."""
    return text.split()


#: Bytes of text that are turned into Python objects at once; a longer text goes alone.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, by rows and by the bytes of its texts."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for column in b.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, min(at + rows, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1))
            yield b.slice(at, stop - at)
            at = stop


def binary(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
