"""Operator 6: quality rules from cross-document line frequency."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, durable, release, ship, slices, words

SYMBOLS = re.compile(rb"[#*$%&|<>]")
PROFILE = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:int>>"


def normalise(line: bytes) -> bytes:
    """A line as it is compared: ASCII lower case, single spaces, none at the ends."""
    return b" ".join(line.lower().split())


def signed_hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def repeated_words(ws: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    if len(ws) <= width:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
    key = x[: len(x) - width + 1].copy()
    for k in range(1, width):
        _, key = np.unique(key * len(ids) + x[k : len(x) - width + 1 + k], return_inverse=True)
    often = np.bincount(key)[key] > 1
    hit = np.zeros(len(x), bool)
    for k in range(width):
        hit[k : len(often) + k] |= often
    return int(hit.sum())


def profile_text(text: bytes) -> tuple[int, int, int, int, int, list[dict]]:
    ws = words(text)
    # Code points are the bytes that do not continue a character.
    chars = sum(map(len, ws)) - len(re.findall(rb"[\x80-\xbf]", text))
    lines = [x for x in text.split(b"\n") if x.split()]
    normal = Counter(map(normalise, lines))
    kept = [{"hash": signed_hash(x), "words": n * (x.count(b" ") + 1)} for x, n in normal.items()]
    return len(ws), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(ws), kept


def _profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for b in slices(batches):
        texts = binary(b.column("text"))
        cols = list(zip(*map(profile_text, texts), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), pa.array(map(signed_hash, texts), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "host", "text_hash", *names])


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A narrow row per document: base figures and its distinct normalised lines as hashes."""
    ship(docs.sparkSession)
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), host.alias("host")).mapInArrow(_profile, PROFILE)


def frequent_lines(profiled: DataFrame, least_documents: int, share: float, copies_count_once: bool) -> DataFrame:
    """(host, hash) of lines in more than ``least_documents`` distinct documents of the host, however large it is.

    A document is a doc_id (rows without one are told apart by their texts), or a text with
    ``copies_count_once``. A ``share`` above 0 asks for more than that share of the host's
    documents too. Counts are taken of (host, line, document) first, which spreads a line that
    is everywhere over all tasks.
    """
    document = ["text_hash"] if copies_count_once else ["doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("unnamed")]
    seen = profiled.select("host", *document, F.explode("lines.hash").alias("hash")).distinct()
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("documents")).where(F.col("documents") > least_documents)
    if not share:
        return counts.select("host", "hash")
    hosts = profiled.select("host", *document).distinct().groupBy("host").agg(F.count("*").alias("host_documents"))
    return counts.join(hosts, "host").where(F.col("documents") > F.col("host_documents") * share).select("host", "hash")


def line_rules(docs: DataFrame, least_documents: int = 20, share: float = 0.0, copies_count_once: bool = False, depleted: float = 0.5, min_words: int = 50, max_repeat: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, base figures, base_failed, removed_words, kept.

    Lines in more than ``least_documents`` documents of their host are removed, those of
    copies too; a document that keeps less than ``depleted`` of its words is rejected, as is
    one that fails the base rules. Equal texts of a host have equal lines, so removed words
    are summed once for each text.

    Null text has no words and fails the base rules; null is a host of its own; rows that
    repeat a doc_id are one document to the counts and each get a row; a line of any length
    is one line; other columns are not read; an empty table gives an empty result.
    """
    base = durable(profiles(docs, id_col, text_col, host_col))
    frequent = durable(frequent_lines(base, least_documents, share, copies_count_once))
    lines = base.select("host", "text_hash", F.explode("lines").alias("line")).select("host", "text_hash", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    removed = lines.join(frequent, ["host", "hash"]).groupBy("host", "text_hash", "hash").agg(F.first("words").alias("words")).groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"))
    removed = durable(removed)
    release(frequent)
    out = base.drop("lines").join(removed, ["host", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat)
    kept = ~failed & (F.col("n_words") - F.col("removed_words") >= F.col("n_words") * depleted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "removed_words")


def remove_lines(docs: DataFrame, least_documents: int = 20, share: float = 0.0, copies_count_once: bool = False, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id and the text without the lines above the limits; other lines stay as they were."""
    base = durable(profiles(docs, id_col, text_col, host_col))
    frequent = durable(frequent_lines(base, least_documents, share, copies_count_once))
    lines = base.select("host", "text_hash", F.explode("lines.hash").alias("hash")).distinct()
    cut = durable(lines.join(frequent, ["host", "hash"]).groupBy("host", "text_hash").agg(F.collect_set("hash").alias("cut")))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(signed_hash, binary(b.column("text"))), pa.int64())], names=["doc_id", "text", "host", "text_hash"])

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, c in zip(b.column("text").to_pylist(), b.column("cut").to_pylist(), strict=True):
                gone = set(c or ())
                out.append(t if not gone or t is None else "\n".join(x for x in t.split("\n") if signed_hash(normalise(x.encode())) not in gone))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), host.alias("host")).mapInArrow(hashed, "doc_id long, text string, host string, text_hash long")
    return rows.join(cut, ["host", "text_hash"], "left").select("doc_id", "text", "cut").mapInArrow(clean, "doc_id long, text string")
