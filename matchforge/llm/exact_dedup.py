"""Operator 10: exact dedup by 128-bit content hash with byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sealed(rows: DataFrame, keep: str) -> DataFrame:
    """(h, s, n, best) of the texts that several rows (doc_id, h, t) have."""
    best = {"min": F.min, "max": F.max}[keep]
    classes = rows.groupBy("h", "t").agg(F.count("*").alias("n"), best("doc_id").alias("best"))
    several = classes.where("n > 1").select("h", F.sha2("t", 256).alias("s"), "n", "best")
    sealed = several.groupBy("h", "s").agg(F.count("*").alias("texts"), F.first("n").alias("n"), F.first("best").alias("best"))
    return durable(sealed.select("h", "s", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share both hashes"))).cast("long").alias("n"), "best"))


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (128-bit hash, text): the hash is what spreads them, and the text as
    second key makes Spark compare bytes, so texts whose hashes collide form classes of their
    own. Copies are counted before the shuffle, hence each task sends a text at most once and
    a group of any size is a handful of rows. Only classes of two or more rows are kept, as
    (hash, SHA-256, size, id), and joined back to narrow rows; Spark splits the join where a
    class is hot. Two texts of one class key would be an SHA-256 collision: the job then
    fails rather than merge them.

    ``keep``: "min" or "max" id stays. Null text counts as empty. A null id never wins over a
    real one; rows that repeat id and text stand or fall together. An empty table gives an
    empty result. A text of any length is hashed and compared whole. Columns other than the id
    and the text are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", hashed(F.col("t")))
    narrow = rows.select("doc_id", "h", F.sha2("t", 256).alias("s"))
    out = narrow.join(_sealed(rows, keep), ["h", "s"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("s").alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``exact_duplicates`` keeps."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sealed = _sealed(docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), content_hash(text).alias("h")), keep)
    # What falls is narrower than what stays, and each side's columns keep apart in a struct.
    rows = docs.select(F.struct("*").alias("row"), content_hash(text).alias("h"), F.sha2(text, 256).alias("s"), F.col(id_col).alias("id"))
    fallen = (rows["h"] == sealed["h"]) & (rows["s"] == sealed["s"]) & ~rows["id"].eqNullSafe(sealed["best"])
    return rows.join(sealed, fallen, "left_anti").select("row.*")
