"""Operator 13: cross-tokenizer alignment over packed bitsets of token ends."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ship, slices
from .packing import TokenBytes

#: Segments longer than this are not remembered, and so many are at most.
LONGEST, MOST = 48, 400_000
DOCS = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, keys array<long>, docs array<int>"


class Bits:
    """A set of positions as packed 64-bit words with a rank directory."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, positions: np.ndarray, size: int) -> Bits:
        marks = np.zeros((size + 64) // 64 * 64, np.uint8)
        marks[positions] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many members are below each position."""
        low = (np.uint64(1) << (positions & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[positions >> 6] + np.bitwise_count(self.words[positions >> 6] & low)

    def select(self) -> np.ndarray:
        """All members in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@lru_cache
def _byte_tokens(tokenizer_path: str) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary, by id."""
    from tokenizers import Tokenizer

    # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    t = Tokenizer.from_file(tokenizer_path)
    special = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    out = [b""] * t.get_vocab_size()
    for piece, i in t.get_vocab().items():
        out[i] = special[i] if i in special else bytes(byte_of[c] for c in piece)
    return out


class PieceIds:
    """Ids of texts by a piece vocabulary, as little-endian 32-bit bytes.

    A space only begins pieces, so runs of spaces with the characters that follow are
    encoded apart and remembered; a vocabulary with a space inside a piece is refused.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a space after another character cannot be encoded word by word")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.known: dict[str, bytes] = {}

    def _segment(self, segment: str) -> bytes | None:
        # The model gives an empty text no space; a lone space at the end of a text is a segment.
        ids = self.model.encode(segment[1:]) if segment != " " else [self.model.piece_to_id("▁")]
        if b"".join(map(self.bytes.__getitem__, ids)) != segment.encode():
            return None
        return np.array(ids, "<u4").tobytes()

    def of(self, text: str) -> bytes | None:
        """Ids of a text, or None if their bytes are not a space and the text."""
        segments = re.findall(" +[^ ]*", " " + text)
        known = self.known
        try:
            out = b"".join(map(known.__getitem__, segments))
        except KeyError:
            if len(known) > MOST:
                known.clear()
            parts = []
            for s in segments:
                ids = known.get(s)
                if ids is None:
                    ids = self._segment(s)
                    if ids is None:
                        return None
                    if len(s) <= LONGEST:
                        known[s] = ids
                parts.append(ids)
            out = b"".join(parts)
        return out


@lru_cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """For code = 4 * id + mark, the bytes of the id and its mark (none , | ;), and which of them count."""
    texts = [f"{i}{mark}".encode() for i in range(1 << 16) for mark in ("", ",", "|", ";")]
    size = np.array([len(t) for t in texts])
    return np.array(texts, "S6").view(np.uint8).reshape(-1, 6), np.arange(6) < size[:, None]


class Aligned:
    """Groups and links of a batch of texts, whose bytes lie one after another.

    ``a`` and ``b`` are ids of all texts, ``ends`` the byte ends of the texts. Bits mark the
    last byte of each token; the intersection is the shared cuts, and the union has one
    member for each pair of tokens that overlap, as such a pair shares one unbroken range.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, ends: np.ndarray):
        total = int(ends[-1]) if len(ends) else 0
        in_a, in_b = Bits.at(np.cumsum(size_a[a]) - 1, total), Bits.at(np.cumsum(size_b[b]) - 1, total)
        shared, either = in_a & in_b, in_a | in_b
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        count = lambda bits: bits.rank(ends) - bits.rank(begins)
        self.n_a, self.n_b, self.n_groups, self.n_links = map(count, (in_a, in_b, shared, either))
        self.a, self.b = a, b
        cuts = shared.select()
        # Tokens up to and with each cut, in both vocabularies: the token ranges of the groups.
        self.upto_a, self.upto_b = in_a.rank(cuts) + 1, in_b.rank(cuts) + 1
        at = either.select()
        self.pairs = a[in_a.rank(at)].astype(np.int64) << 16 | b[in_b.rank(at)]

    def digests(self) -> list[str]:
        """For each text, SHA-256 of its groups in decimal."""
        group_a = np.repeat(np.arange(len(self.upto_a)), np.diff(self.upto_a, prepend=0))
        group_b = np.repeat(np.arange(len(self.upto_b)), np.diff(self.upto_b, prepend=0))
        code_a, code_b = 4 * self.a.astype(np.int64) + 1, 4 * self.b.astype(np.int64) + 1
        code_a[self.upto_a - 1] += 1
        code_b[self.upto_b - 1] += 2
        last = np.cumsum(self.n_b)[self.n_b > 0] - 1
        code_b[last] -= 3
        merged = np.empty(len(code_a) + len(code_b), np.int64)
        before_b = np.concatenate([[0], self.upto_b])
        merged[np.arange(len(code_a)) + before_b[group_a]] = code_a
        merged[np.arange(len(code_b)) + self.upto_a[group_b]] = code_b
        texts, counts = _decimals()
        keep = counts[merged]
        flat = texts[merged][keep].tobytes()
        upto = np.concatenate([[0], np.cumsum(keep.sum(1))])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


class Encoders:
    """Both vocabularies, and the lengths of their tokens."""

    def __init__(self, byte_path: str, ranks_path: str | None, piece_path: str):
        self.first = TokenBytes(byte_path, ranks_path, specials_as_text=True)
        self.second = PieceIds(piece_path)
        self.first_bytes = _byte_tokens(byte_path)
        self.size_a = np.array([len(x) for x in self.first_bytes])
        self.size_b = np.array([len(x) for x in self.second.bytes])

    def align(self, texts: list[str | None]) -> tuple[Aligned, list[int]]:
        """What the texts give, and which of them have tokens at all."""
        a, b, ends, used, upto = [], [], [], [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            second = self.second.of(text)
            if second is None:
                continue
            whole = (" " + text).encode()
            first = np.frombuffer(self.first.of(" " + text), "<u4")
            if b"".join(map(self.first_bytes.__getitem__, first.tolist())) != whole:
                continue
            upto += len(whole)
            a.append(first)
            b.append(np.frombuffer(second, "<u4"))
            ends.append(upto)
            used.append(k)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
        return Aligned(join(a), join(b), self.size_a, self.size_b, np.array(ends, np.int64)), used


def _packed(values: np.ndarray, upto: np.ndarray) -> list[bytes]:
    raw = values.astype("<u4").tobytes()
    return [raw[4 * i : 4 * j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def align_slices(byte_path: str, ranks_path: str | None, piece_path: str, slice_bytes: int):
    """For mapInArrow: (doc_id, text) to a row per document and one per slice.

    A document's row has its digest and its distinct pairs as places in the slice's list of
    pairs; the slice's row has that list and the number of documents for each.
    """

    def close(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(h[-1]) for h in held]
        keys, place, docs = np.unique(np.concatenate([h[-2] for h in held]), return_inverse=True, return_counts=True)
        at = 0
        for (ids, n_a, n_b, n_groups, n_links, sha, per_doc, _, times), size in zip(held, sizes, strict=True):
            upto = np.concatenate([[0], np.cumsum(per_doc)])
            places = place[at : at + size].astype(np.int64)
            at += size
            steps = np.diff(places, prepend=0)
            first = upto[:-1][per_doc > 0]
            steps[first] = places[first]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(sha, pa.string()), pa.array(_packed(steps, upto), pa.binary()), pa.array(_packed(times, upto), pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))],
                names=[c.split()[0] for c in DOCS.split(", ")],
            )
        for i in range(0, len(keys), 1 << 17):
            k, d = keys[i : i + (1 << 17)], docs[i : i + (1 << 17)].astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), one(k), one(d)], names=[c.split()[0] for c in DOCS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(byte_path, ranks_path, piece_path)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            got, used = encoders.align(texts)
            spread = lambda x: np.bincount(used, x, len(texts)).astype(np.int64) if used else np.zeros(len(texts), np.int64)  # noqa: E731, B023
            doc = np.repeat(np.array(used, np.int64), got.n_links)
            distinct, times = np.unique(doc << 32 | got.pairs, return_counts=True)
            sha = [""] * len(texts)
            for k, x in zip(used, got.digests(), strict=True):
                sha[k] = x
            per_doc = np.bincount(distinct >> 32, minlength=len(texts))
            held.append((ids, *map(spread, (got.n_a, got.n_b, got.n_groups, got.n_links)), sha, per_doc, distinct & 0xFFFFFFFF, times))
            size += b.nbytes
            if size >= slice_bytes:
                yield from close(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield from close(number, held)

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A slice's documents with the corpus-wide counts of its pairs."""
    order = np.argsort(pairs.column("key").to_numpy())
    count, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    n_best, count_sum = [], []
    for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, n = np.cumsum(np.frombuffer(places, "<u4").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(best[at] @ n))
        count_sum.append(int(count[at] @ n))
    given = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    made = given | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({c: made[c] for c in (x.split()[0] for x in RESULT.split(", "))})


def align(docs: DataFrame, byte_path: str, ranks_path: str | None, piece_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded once, in slices of about ``slice_bytes``. A slice counts its own pairs,
    so a pair that is everywhere gives one row a slice; the counts are added up by Spark and
    come back to each slice by a join that Spark may split. Nothing that grows with the corpus is
    broadcast: the best count of each id of the first vocabulary is, at most its size in rows.

    Null and empty texts, and those that either vocabulary does not give back byte for byte,
    have no tokens: zeros and an empty digest. A text of any length is encoded whole. Each row
    counts as a document, repeated ones too. Null ids stay null. An empty table gives an empty result. No other column is read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = durable(texts.mapInArrow(align_slices(byte_path, ranks_path, piece_path, slice_bytes), DOCS))
    rows = base.where("keys is not null").select("slice", F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("slice", F.col("x.keys").alias("key"), F.col("x.docs").alias("docs"))
    counts = durable(rows.groupBy("key").agg(F.sum("docs").alias("count")))
    top = counts.groupBy(F.shiftright("key", 16).alias("a")).agg(F.max("count").alias("top"))
    ranked = counts.withColumn("a", F.shiftright("key", 16)).join(F.broadcast(top), "a").select("key", "count", (F.col("count") == F.col("top")).alias("best"))
    back = rows.select("slice", "key").join(ranked, "key")
    given = base.where("keys is null").drop("keys", "docs").withColumnRenamed("slice", "home")
    return given.groupBy("home").cogroup(back.groupBy("slice")).applyInArrow(_summed, RESULT)
