"""Operator 7: best-fit packing with exact-complement hashing."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ship, slices
from .tokenizers import byte_pattern

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A run of word bytes or of white space longer than this costs the fast encoder more than its length; the exact one takes the text.
LONGEST_RUN = 4_096
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache
def _exact_encoder(tokenizer_path: str, specials_as_text: bool = False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    t.encode_special_tokens = specials_as_text
    return t


@lru_cache
def _fast_encoder(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=byte_pattern(), mergeable_ranks=ranks, special_tokens={})


class TokenBytes:
    """Ids of texts as little-endian 32-bit bytes.

    With ``ranks_path``, the ranks of the same vocabulary, ordinary texts go through the
    library that reads ranks, which gives the same ids in a third of the time. Texts with a
    special token or a very long run go through the tokenizer itself. With
    ``specials_as_text`` a special token's string in a text is ordinary text.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, specials_as_text: bool = False):
        self.exact = _exact_encoder(tokenizer_path, specials_as_text)
        self.fast = _fast_encoder(ranks_path) if ranks_path else None
        self.special = [] if specials_as_text else [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def _plain(self, text: str) -> bool:
        if self.fast is None or any(s in text for s in self.special):
            return False
        space = _SPACE[np.frombuffer(text.encode(), np.uint8)]
        turns = np.flatnonzero(space[1:] != space[:-1])
        return np.diff(turns, prepend=-1, append=len(space) - 1).max() <= LONGEST_RUN

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if self._plain(text):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def tokenize_pieces(tokenizer_path: str, ranks_path: str | None, capacity: int, end_id: int):
    """For mapInArrow: (doc_id, text) to pieces of at most ``capacity`` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(tokenizer_path, ranks_path)
        for b in slices(batches):
            ids, rows = b.column(0).to_pylist(), []
            for doc_id, text in zip(ids, b.column(1).to_pylist(), strict=True):
                raw = tokens.of(text or "") + end
                n = len(raw) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(memoryview(raw)[4 * start : 4 * stop])))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) that use every piece once, in as few sequences as best-fit decreasing needs or fewer.

    Works on counts by length, so its size depends on the capacity and not on the documents.
    Combinations that fill a gap exactly are consumed first, then best-fit takes the rest.
    Where few pieces have a length, pairs and triples use up what best-fit would fill its
    last gaps with. So plans that leave each length some pieces are made too (the last one
    by best-fit alone), and the one of fewest sequences is used; of equal ones the first.
    """
    plans = []
    for spare in (0, 4, 16, 64, None):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            left[length] = n
        exact = [] if spare is None else _exact_fills(left, capacity, spare)
        plans.append(exact + _best_fit(left, capacity))
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _exact_fills(left: np.ndarray, capacity: int, spare: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes from ``left`` the lengths whose gap one, two or three others fill; two and three come from what lengths have above ``spare``."""
    out = []
    kept = np.minimum(left, spare)
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            fill = _exact(left, np.maximum(left - kept, 0), capacity - length)
            left[length] += 1
            if fill is None:
                break
            pattern = (length, *fill)
            need = Counter(pattern)
            times = max(1, min((int(left[x]) - (int(kept[x]) if len(fill) > 1 and x != length else 0)) // k for x, k in need.items()))
            for x, k in need.items():
                left[x] -= k * times
            out.append((pattern, times))
    return out


def _pair(have: np.ndarray, total: int) -> list[int] | None:
    """Two available lengths of this sum, the most equal ones first."""
    small = np.arange(1, total // 2 + 1)
    ok = (have[small] > 0) & (have[total - small] > 0) & ((2 * small != total) | (have[small] > 1))
    hit = np.flatnonzero(ok)
    return [total - int(small[hit[-1]]), int(small[hit[-1]])] if len(hit) else None


def _exact(left: np.ndarray, have: np.ndarray, gap: int) -> list[int] | None:
    """Lengths that fill the gap: none, one that is left, or two or three that are had."""
    if gap == 0 or left[gap] > 0:
        return [gap] if gap else []
    if pair := _pair(have, gap):
        return pair
    there = (have[: gap + 1] > 0).astype(np.float64)
    there[0] = 0
    sums = np.convolve(there, there)[: gap + 1] > 0.5  # which totals two lengths reach
    thirds = np.flatnonzero((there[1:] > 0) & sums[gap - np.arange(1, gap + 1)]) + 1
    for x in thirds[np.argsort(np.abs(3 * thirds - gap), kind="stable")].tolist():
        have[x] -= 1
        pair = _pair(have, gap - x)
        have[x] += 1
        if pair:
            return [x, *pair]
    return None


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of all pieces in ``left``; sequences of one content are one entry with a number."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    full = []
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            room = capacity if gap is None else gap
            fit = min(room // length, n)
            pattern, number = ((), n // fit) if gap is None else open_[gap].pop()
            if gap is not None and number > n // fit:
                open_[gap].append((pattern, number - n // fit))
            elif gap is not None and not open_[gap]:
                del open_[gap]
            times = min(number, n // fit)
            done = (pattern + (length,) * fit, times)
            rest = room - fit * length
            open_.setdefault(rest, []).append(done) if rest else full.append(done)
            n -= times * fit
    return full + [p for v in open_.values() for p in v]


def place_pieces(patterns: list[tuple[tuple[int, ...], int]]):
    """For mapInArrow: pieces with their rank within the length get sequence and offset."""
    spans: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            spans.setdefault(x, []).append((used[x], first, offset))
            used[x] += times
            offset += x
        first += times
    table = {x: np.array(v, dtype=np.int64).T for x, v in spans.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                lo, base, offset = table[x]
                i = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at], off[at] = base[i] + rank[at] - lo[i], offset[i]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenized once and cut; pieces are written without their ids. The driver gets
    the count of each length (at most ``capacity`` numbers) and plans patterns of lengths.
    Each piece finds its place from its length and its rank among pieces of that length; a
    rank is a part's offset plus the place in the part, so a length that a third of the
    pieces share is ranked by many tasks.

    Null text counts as empty and gives the end id alone. A text of any length is tokenized
    whole and only then cut. Repeated rows are packed as often as they come, and pieces of
    one length that tie take places in order of id. Null ids stay null. An empty table gives
    an empty result. No other column is read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(texts.mapInArrow(tokenize_pieces(tokenizer_path, ranks_path, capacity, end_id), PIECES))
    total = pieces.count()
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(4, total // 200_000))).cast("int")
    pieces = pieces.withColumn("part", part)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    offsets = durable(counts.select("length", "part", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first")))
    by_length = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.withColumn("within", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets.select("length", "part", "first"), ["length", "part"]).withColumn("rank", F.col("first") + F.col("within"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(place_pieces(plan_patterns(by_length, capacity)), PIECES + ", sequence_id long, offset long")
