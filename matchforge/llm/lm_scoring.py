"""Operator 4: language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary, crc_mod, durable, release, ship, slices

#: A key's region in a filter comes from a hash of it. A filter over a whole table of counts has 2**FILTER_BITS bits.
FILTER_BITS, REGIONS = 28, 256
#: Bits that one entry sets, bits of a part's filter for each of its entries, and bits of a region at least.
PROBES, ENTRY_BITS, REGION_BITS = 4, 16, 1024
#: Bytes of text in a slice (about), and keys in a part (about, before copies in a slice are joined): what one task holds.
SLICE_BYTES, PART_KEYS = 3 << 20, 7 << 18
#: Counts are held as floor(log(count) / log(BASE)) + 1.
BASE = 1.5
#: Without effect since every slice of texts is told the exact counts of all its words; tests set it.
COMMON = 200_000
#: Weights of the pair estimate to choose from.
WEIGHTS = (0.01, 0.05, 0.1, 0.2, 0.35, 0.5)
END = np.uint64(xxhash.xxh64_intdigest(b"", seed=7))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def token_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased words and the end."""
    ws = text.lower().split()
    out = np.empty(len(ws) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    out[-1] = END
    return out


def gram_keys(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token and of each pair with the token before (a text begins after an end). The lowest bit tells them apart."""
    flat = np.concatenate(tokens)
    before = np.empty_like(flat)
    before[0], before[1:] = END, flat[:-1]  # each text stops with the end
    pair = (before * _MIX[0]) ^ flat
    pair = (pair ^ (pair >> np.uint64(31))) * _MIX[1]
    return flat & ~np.uint64(1), pair | np.uint64(1)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts a key, by its upper half; sorted keys are sorted by part."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def level_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64) + 1


def _positions(keys: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    """Bits within the key's region."""
    h = (keys ^ np.uint64((level * 64 + probe) * 0x632BE59BD9B4E019 & (2**64 - 1))) * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return (h >> np.uint64(40)) % np.uint64(size)


def _region(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(23))) * _MIX[1] >> np.uint64(56)).astype(np.int64)


class Filter:
    """Holds a level for each key: the key is a member once for every level up to its own."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, bits.size * 8 // REGIONS

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The key's level, by probing membership until it fails. Never below the truth."""
        out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        start = _region(keys) * self.size
        level = 1
        while len(alive):
            for probe in range(PROBES):
                at = start[alive] + _positions(keys[alive], level, probe, self.size).astype(np.int64)
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = level
            level += 1
            if level > 60:
                break
        return out


def _fill(keys: np.ndarray, level: np.ndarray, size: int) -> np.ndarray:
    """A filter's bits with regions of ``size`` bits (a multiple of 8)."""
    bits = np.zeros(REGIONS * size, bool)
    start = _region(keys) * size
    for j in range(1, int(level.max(initial=0)) + 1):
        at = level >= j
        for probe in range(PROBES):
            bits[start[at] + _positions(keys[at], j, probe, size).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def sized_filter(keys: np.ndarray, n: np.ndarray) -> Filter:
    """A filter of all these keys, as large as their entries ask for."""
    level = level_of(n)
    return Filter(_fill(keys, level, max(REGION_BITS, int(level.sum()) * ENTRY_BITS // REGIONS + 8 & ~7)))


def build_filter(counts: DataFrame, least: int) -> np.ndarray:
    """The bytes of one filter of 2**FILTER_BITS bits over counts that fit the driver."""
    x = counts.where(F.col("n") >= least).toPandas()
    return _fill(x["key"].to_numpy(np.int64).view(np.uint64), level_of(x["n"].to_numpy()), (1 << FILTER_BITS) // REGIONS)


class Model:
    """Interpolated word and pair estimates; all counts come from a filter."""

    def __init__(self, bits: np.ndarray, mean: dict[tuple[int, int], float], total: int, unseen: float):
        self.filter, self.unseen, self.total = Filter(bits) if bits is not None else None, unseen, total
        # Mean true count of the keys at each level, for words and for pairs.
        self.mean = [np.array([mean.get((order, j), BASE ** (j - 0.5) if j else 0.0) for j in range(64)]) for order in (0, 1)]

    def parts(self, word: np.ndarray, pair: np.ndarray, start: int, sizes: np.ndarray, less: float) -> tuple[np.ndarray, np.ndarray]:
        """Each token's estimate by its word and by its pair, from levels; ``start`` is the end's level, ``less`` what is left out of the counts."""
        c1, c2 = self.mean[0][word], self.mean[1][pair]
        context = np.empty_like(c1)
        context[1:] = c1[:-1]
        context[np.cumsum(sizes) - sizes] = self.mean[0][start]
        single = np.where(c1 - less > 0, (1 - self.unseen) * (c1 - less) / self.total, self.unseen)
        double = np.minimum(1.0, np.maximum(c2 - less, 0) / np.maximum(context - less, 1))
        return single, np.where(context > 0, double, single)

    def log_probabilities(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability by weight, and with the token itself left out of the counts."""
        word, pair = map(self.filter.levels, gram_keys(tokens))
        start = int(self.filter.levels(np.array([END & ~np.uint64(1)]))[0])
        both = [self.parts(word, pair, start, np.array(list(map(len, tokens))), less) for less in (0.0, 1.0)]
        return tuple(np.log10(np.stack([(1 - w) * single + w * double for w in WEIGHTS], axis=1)) for single, double in both)

    def text_scores(self, word: np.ndarray, pair: np.ndarray, start: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text by weight, and the same with each token left out of its own counts.

        Probabilities are multiplied 16 at a time before the logarithm is taken; each is
        above 1e-18, so no product is lost.
        """
        text = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        cut = np.flatnonzero((np.arange(len(text)) - first[text]) % 16 == 0)
        groups = np.searchsorted(cut, first)
        out = []
        for less in (0.0, 1.0):
            single, double = self.parts(word, pair, start, sizes, less)
            out.append(np.stack([np.add.reduceat(np.log10(np.multiply.reduceat((1 - w) * single + w * double, cut)), groups) for w in WEIGHTS], axis=1))
        return out[0], out[1]


#: Remembered by a worker over the slices it is given.
_HASHES = WordHashes()
_ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("held_out", pa.bool_())])


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 3)


def _spread(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows to slices of them, each one row that holds its texts compressed."""

    def slice_of(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
            out.write_table(pa.Table.from_batches(rows).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "rows"])

    held, size = [], 0
    for b in slices(batches):
        held.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text").cast(pa.binary()), b.column("held_out")], schema=_ROWS))
        size += held[-1].nbytes
        if size >= SLICE_BYTES:
            yield slice_of(held)
            held, size = [], 0
    if held:
        yield slice_of(held)


def _open(rows: bytes) -> tuple[pa.Table, list[np.ndarray]]:
    table = pa.ipc.open_stream(rows).read_all()
    return table, [token_hashes(t, _HASHES) for t in binary(table.column("text"))]


def _short(keys: np.ndarray) -> bytes:
    """The lower six bytes of each key. A part has a bounded number of keys, so two of one part share them with a chance of about 1e-8."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: list[bytes]) -> np.ndarray:
    short = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = short
    return out.view(np.uint64).ravel()


def _packer(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, slice, words, pairs, word_n, pair_n): the distinct keys of a slice of texts by part, and how often its training texts have each."""
        for b in batches:
            for name, rows in zip(b.column("slice").to_pylist(), b.column("rows"), strict=True):
                table, tokens = _open(rows.as_buffer())
                held = [t for t, h in zip(tokens, table.column("held_out").to_pylist(), strict=True) if h]
                cols = []
                # The pair before the first token of a text is with the end, in any choice of texts.
                for every, out in zip(gram_keys(tokens), gram_keys(held) if held else (np.zeros(0, np.uint64),) * 2, strict=True):
                    keys, n = np.unique(every, return_counts=True)
                    found, often = np.unique(out, return_counts=True)
                    n[np.searchsorted(keys, found)] -= often
                    cols.append((keys, n.astype(np.int32), np.searchsorted(part_of(keys, parts), np.arange(parts + 1))))
                some = [p for p in range(parts) if any(cut[p + 1] > cut[p] for _, _, cut in cols)]
                part = lambda k, f: pa.array([f(cols[k][0][cols[k][2][p] : cols[k][2][p + 1]]) for p in some], pa.binary())
                often = lambda k: pa.array([_squeezed(cols[k][1][cols[k][2][p] : cols[k][2][p + 1]]) for p in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([name] * len(some), pa.int64()), part(0, np.ndarray.tobytes), part(1, _short), often(0), often(1)], names=["part", "slice", "words", "pairs", "word_n", "pair_n"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """(part, slice, level, n, hist): of each slice's keys the levels by the part's filter, words first, and the words' exact counts.

    One more row has no slice but the part's keys and their counts, by order and true level.
    """
    counted, size, hist = [], [], np.zeros((2, 128), np.int64)
    for order, width in ((0, 8), (1, 6)):
        name = ("word", "pair")[order]
        asked = table.column(f"{name}s").to_pylist()
        size.append([len(x) // width for x in asked])
        keys, at = np.unique(np.frombuffer(b"".join(asked), np.uint64) if order == 0 else _long(asked), return_inverse=True)
        n = np.bincount(at, np.concatenate([_spread(x, np.int32) for x in table.column(f"{name}_n").to_pylist()]), len(keys)).astype(np.int64)
        counted.append((keys, n, at))
    seen = [n > 0 for _, n, _ in counted]
    for order in (0, 1):
        n = counted[order][1][seen[order]]
        hist[0, 64 * order : 64 * order + 64] = np.bincount(level_of(n), minlength=64)
        hist[1, 64 * order : 64 * order + 64] = np.bincount(level_of(n), n, 64)
    # Pairs have their lowest bit set and words have not, so one filter holds both.
    f = sized_filter(np.concatenate([k[s] for (k, _, _), s in zip(counted, seen, strict=True)]), np.concatenate([n[s] for (_, n, _), s in zip(counted, seen, strict=True)]))
    level = [f.levels(k).astype(np.uint8)[at] for k, _, at in counted]
    n = counted[0][1][counted[0][2]]
    ends = [np.concatenate([[0], np.cumsum(s)]) for s in size]
    rows, part = table.num_rows, table.column("part")[0].as_py()
    return pa.table({
        "part": pa.array([part] * (rows + 1), pa.int32()),
        "slice": pa.array([*table.column("slice").to_pylist(), None], pa.int64()),
        "level": pa.array([*(_squeezed(np.concatenate([level[o][ends[o][k] : ends[o][k + 1]] for o in (0, 1)])) for k in range(rows)), None], pa.binary()),
        "n": pa.array([*(_squeezed(n[ends[0][k] : ends[0][k + 1]]) for k in range(rows)), None], pa.binary()),
        "hist": pa.array([*[None] * rows, hist.ravel().tolist()], pa.list_(pa.int64())),
    })


def _scorer(parts: int, mean: dict[tuple[int, int], float], total: int, unseen: float):
    model = Model(None, mean, max(total, 1), unseen)

    def run(slice_: pa.Table, answers: pa.Table) -> pa.Table:
        table, tokens = _open(slice_.column("rows")[0].as_buffer())
        told = {r["part"]: (_spread(r["level"], np.uint8), _spread(r["n"], np.int64)) for r in answers.to_pylist()}
        sizes = np.array(list(map(len, tokens)))
        found = [np.unique(keys, return_inverse=True) for keys in gram_keys(tokens)]
        cuts = [np.searchsorted(part_of(keys, parts), np.arange(parts + 1)) for keys, _ in found]
        level = [np.zeros(len(keys), np.uint8) for keys, _ in found]
        exact = np.zeros(len(found[0][0]), np.int64)
        for p, (levels, n) in told.items():
            (a, b), (c, d) = (cut[p : p + 2] for cut in cuts)
            level[0][a:b], level[1][c:d], exact[a:b] = levels[: b - a], levels[b - a :], n
        end = np.searchsorted(found[0][0], END & ~np.uint64(1))
        starts = np.cumsum(sizes) - sizes
        n = exact[found[0][1]]
        full, left_out = model.text_scores(level[0][found[0][1]], level[1][found[1][1]], int(level[0][end]), sizes)
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(WEIGHTS))
        base = np.add.reduceat(np.log10(exact + 1)[found[0][1]], starts)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": sizes, "n_known": np.add.reduceat((n > 0).astype(np.int64), starts), "base": base, "full": pa.ListArray.from_arrays(offsets, pa.array(full.ravel())), "left_out": pa.ListArray.from_arrays(offsets, pa.array(left_out.ravel()))})

    return run


def score(docs: DataFrame, fold: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words (lower-cased A-Z) and pairs of all texts but the held-out ones are counted exactly,
    pairs seen once too. Texts are dealt into slices and keys into parts, of which there are
    as many as the text's bytes ask for, so a task's memory does not grow with the input. A
    slice sends each part its distinct keys; the part adds up their counts, puts them as
    logarithmic levels into a Bloom filter sized by its entries, and answers every slice with
    the levels it reads there. No count is left out at any size. Probabilities come from the
    levels: a word's share of all tokens, unseen words having the share of words seen once,
    mixed with the share among what follows the word before. The weight of the mix is the one
    that scores the training texts best when each token is left out of its own counts.

    base_score is exact add-one smoothing; parts answer with words' exact counts too.
    Null text is empty: one token, the end. Null ids train and are not held out. Repeated rows
    count as often as they come. A text longer than a slice is a slice of its own. With no
    training text every token is unseen. An empty table gives an empty result. No other column
    is read.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(crc_mod(id_col, fold) == held, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("texts")).first()
    # A word and the space after it have some six bytes, and each token two keys.
    parts = ((size["bytes"] or 0) // 3 + 2 * size["texts"]) // PART_KEYS + 1
    cut = durable(rows.mapInArrow(_cut, "slice long, rows binary"))
    packed = cut.mapInArrow(_packer(parts), "part int, slice long, words binary, pairs binary, word_n binary, pair_n binary")
    answers = durable(packed.groupBy("part").applyInArrow(_answer, "part int, slice long, level binary, n binary, hist array<long>"))
    sums = {r["pos"]: r["n"] for r in answers.where("slice is null").select(F.posexplode("hist")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    keys, often = (np.array([[sums.get(at + 64 * order + j, 0) for j in range(64)] for order in (0, 1)]) for at in (0, 128))
    total, distinct, once = int(often[0].sum()), int(keys[0].sum()), int(keys[0, 1])  # the first level is one
    mean = {(order, j): float(often[order, j] / keys[order, j]) for order in (0, 1) for j in range(64) if keys[order, j]}
    unseen = min(0.5, max(once, 1) / max(total, 2))
    told = answers.where("slice is not null").select("slice", "part", "level", "n")
    scored = durable(cut.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_scorer(parts, mean, total, unseen), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, full array<double>, left_out array<double>"))
    release(answers, cut)
    fits = scored.where("not held_out").agg(*(F.sum(F.col("left_out")[k]).alias(str(k)) for k in range(len(WEIGHTS)))).first()
    best = max(range(len(WEIGHTS)), key=lambda k: (fits[k] if fits[k] is not None else 0.0, -k))
    base = F.col("base") - F.col("n_tokens") * math.log10(total + distinct + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("full")[best].alias("score"))
