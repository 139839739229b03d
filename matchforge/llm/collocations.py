"""Operator 12: phrase collocations, mined by pivot partitioning."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, durable, release, ship, slices

#: Longest phrase; a fragment holds so many words less one on each side of its pivot.
WIDTH = 5
SIDE = WIDTH - 1
WORDS = [f"w{k}" for k in range(1, WIDTH + 1)]
#: Lower-cases A-Z and turns what ends a piece into a byte that no text has.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10)
SLICES = "slice long, codes binary, lang string, words array<string>, numbers array<int>, times array<long>"


class Numbered(dict):
    """Words to numbers in order of appearance; one counter serves all languages of a slice."""

    def __init__(self, counter: Iterator[int]):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self[word] = next(self.counter)
        return n


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with the byte 0xFF between pieces."""
    return text.translate(_FOLD).replace(b"\xff", b" \xff ").split()


def number_slices(slice_bytes: int):
    """For mapInArrow: (lang, text) to a slice's words as numbers, and its dictionary by language."""
    names = [c.split()[0] for c in SLICES.split(", ")]

    def close(number: int, held: list[np.ndarray], books: dict[str, Numbered]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(held)
        times = np.bincount(codes[codes >= 0], minlength=sum(map(len, books.values())))
        raw = _deflate(codes)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([raw], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64()))], names=names)
        for lang, book in books.items():
            words, numbers = list(book), np.fromiter(book.values(), np.int32, len(book))
            for i in range(0, len(words), 1 << 16):
                part = slice(i, i + (1 << 16))
                cells = [pa.array([x], t) for x, t in (([w.decode() for w in words[part]], pa.list_(pa.string())), (numbers[part].tolist(), pa.list_(pa.int32())), (times[numbers[part]].tolist(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.binary()), pa.array([lang]), *cells], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []
        counter = count()
        books: dict[str, Numbered] = defaultdict(lambda: Numbered(counter))
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), binary(b.column("text")), strict=True):
                book = books[lang]
                book[b"\xff"] = -1
                held.append(np.array([*map(book.__getitem__, tokens(text)), -1], np.int32))
                del book[b"\xff"]
                size += len(text)
            if size >= slice_bytes:
                yield from close(number, held, books)
                number, size, held = number + 1, 0, []
                counter = count()
                books.clear()
        if held:
            yield from close(number, held, books)

    return run


def _deflate(numbers: np.ndarray) -> bytes:
    """32-bit numbers, packed byte by byte of their places, as most are small."""
    return zstandard.ZstdCompressor(5).compress(np.ascontiguousarray(numbers, "<i4").reshape(-1, 1).view(np.uint8).T.tobytes())


def _inflate(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


class Slice:
    """A slice's words in order of frequency, and the fragments of its pivots.

    A pivot takes up to four words on each side. All are as frequent or more, and those
    before it are not the pivot itself; so a phrase is met once in each place, at the first
    of its rarest words. Other words, and the ends of pieces, end a fragment.
    """

    def __init__(self, data: pa.Table, back: pa.Table):
        codes = _inflate(data.column("codes")[0].as_py())
        number, ids, f, many = np.concatenate([np.zeros((4, 0), np.int64), *(_inflate(x).reshape(4, -1).astype(np.int64) for x in back.column("known").to_pylist())], axis=1)
        f = f | many << 31
        order = np.lexsort((ids, -f))
        self.ids, self.f, number = ids[order], f[order], number[order]
        self.none = len(number)
        # The last entry stands for -1.
        rank = np.full(max(int(codes.max(initial=-1)), int(number.max(initial=-1))) + 2, self.none, np.int32)
        rank[number] = np.arange(self.none)
        self.at = np.concatenate([np.full(SIDE, self.none, np.int32), rank[codes], np.full(SIDE, self.none, np.int32)])

    def fragments(self, step: int = 400_000) -> Iterator[np.ndarray]:
        """Rows of nine ranks, the pivot in the middle, -1 where nothing is."""
        at = self.at
        for begin in range(SIDE, len(at) - SIDE, step):
            here = np.arange(begin, min(begin + step, len(at) - SIDE))
            here = here[at[here] < self.none]
            pivot = at[here]
            before, after = at[here - 1] < pivot, at[here + 1] <= pivot
            here, pivot = here[before | after], pivot[before | after]
            rows = np.full((len(here), 2 * SIDE + 1), -1, np.int32)
            rows[:, SIDE] = pivot
            for side in (-1, 1):
                open_ = np.ones(len(here), bool)
                for k in range(1, SIDE + 1):
                    x = at[here + side * k]
                    open_ &= x < pivot if side < 0 else x <= pivot
                    rows[open_, SIDE + side * k] = x[open_]
            yield rows


def _added_up(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each comes. Rows are brought together by hash and compared; a collision only leaves equal ones apart."""
    h = _hash_rows(rows)
    order = np.argsort(h)
    rows, h = rows[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(1)
    return rows[new], np.diff(np.append(np.flatnonzero(new), len(rows)))


KNOWN = "home long, known binary"


def hand_back(most: int = 1 << 20):
    """For mapInArrow: (id, f, places) of words to what each slice gets: its numbers of them, their ids and counts, packed in one row a slice."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        home, *known = np.concatenate(held, axis=1)
        order = np.argsort(home, kind="stable")
        home, known = home[order], np.stack(known)[:, order]
        cuts = np.flatnonzero(np.diff(home, prepend=-1))
        blobs = [_deflate(known[:, i:j]) for i, j in zip(cuts, np.append(cuts, len(home))[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(home[cuts]), pa.array(blobs, pa.binary())], names=["home", "known"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            places = b.column("places")
            home, number = places.flatten().flatten()
            n = np.diff(places.offsets.to_numpy())
            f = b.column("f").to_numpy()
            held.append(np.stack([home.to_numpy(), number.to_numpy(), np.repeat(b.column("id").to_numpy(), n), np.repeat(f & 0x7FFFFFFF, n), np.repeat(f >> 31, n)]))
            size += len(home)
            if size >= most:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


ROUTED = "part int, pivot int, beside int, mode int, rows long, fragments binary"


def route(parts: int, hot: int):
    """For a cogroup: a slice's fragments, equal ones added up, packed by what mines them.

    A pivot of at most ``hot`` occurrences is mined whole by one part. A more frequent one is
    split by the word after it (mode 1), and for phrases that it ends by the word before it
    (mode 2), which keeps phrases whole as well; such classes get their part when the size
    of all of them is known.
    """

    def run(data: pa.Table, back: pa.Table) -> pa.Table:
        s = Slice(data, back)
        # Little is kept of a step: ids and numbers of its distinct fragments.
        held, modes = [np.zeros((0, 2 * SIDE + 2), np.int32)], [np.zeros(0, np.int32)]
        for rows in s.fragments():
            whole = s.f[rows[:, SIDE]] <= hot
            ends = rows[~whole & (rows[:, SIDE - 1] >= 0)].copy()
            ends[:, SIDE + 1 :] = -1
            goes_on = rows[~whole & (rows[:, SIDE + 1] >= 0)]
            mode = np.repeat(np.array([0, 2, 1], np.int32), [int(whole.sum()), len(ends), len(goes_on)])
            rows, n = _added_up(np.column_stack([np.concatenate([rows[whole], ends, goes_on]), mode]))
            mode, rows = rows[:, -1], rows[:, :-1]
            held.append(np.column_stack([np.append(s.ids, -1).astype(np.int32)[rows], n]).astype(np.int32))
            modes.append(mode)
        wide, mode = np.concatenate(held), np.concatenate(modes)
        del held
        pivot = wide[:, SIDE]
        beside = np.where(mode == 0, -1, np.where(mode == 1, wide[:, SIDE + 1], wide[:, SIDE - 1]))
        part = np.where(mode == 0, (_hash_rows(pivot[:, None]) % np.uint64(parts)).astype(np.int32), -1)
        own = np.where(mode == 0, -1, pivot)
        order = np.lexsort((wide[:, SIDE + 1], pivot, beside, own, mode, part))
        key = np.column_stack([part, own, beside, mode])[order]
        cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else np.zeros(0, np.int64)
        stops = np.append(cuts, len(key))[1:]
        blobs = [_deflate(wide[order[i:j]].T) for i, j in zip(cuts, stops, strict=True)]
        part, own, beside, mode = (pa.array(x.astype(np.int32)) for x in key[cuts].T)
        part = pc.if_else(pc.equal(mode, 0), part, pa.scalar(None, pa.int32()))
        return pa.table([part, own, beside, mode, pa.array((stops - cuts).astype(np.int64)), pa.array(blobs, pa.binary())], names=[c.split()[0] for c in ROUTED.split(", ")])

    return run


FOUND = ", ".join(f"{w} int" for w in WORDS) + ", a long"


def mine(least: int):
    """For groups by part: phrases that hold the pivot of their fragment, with counts.

    Longer phrases come from shorter ones that are frequent. Partial counts are all returned.
    """

    def run(group: pa.Table) -> pa.Table:
        blobs = [_inflate(x).reshape(2 * SIDE + 2, -1).T for x in group.column("fragments").to_pylist()]
        rows, sizes = np.concatenate(blobs), [len(x) for x in blobs]
        fragment, n = rows[:, : 2 * SIDE + 1], rows[:, -1]
        after = np.repeat(group.column("mode").to_numpy() == 1, sizes)
        partial = np.repeat(group.column("partial").to_numpy(zero_copy_only=False), sizes)
        codes: dict[tuple[int, int], np.ndarray] = {}
        out, totals = [], []
        for m in range(2, WIDTH + 1):
            keys, at, starts = [], [], []
            for s in range(max(0, SIDE - m + 1), SIDE + 1):
                e = s + m - 1
                if e > 2 * SIDE:
                    continue
                alive = (fragment[:, s] >= 0) & (fragment[:, e] >= 0)
                if e == SIDE:
                    alive &= ~after
                if m == 2:
                    key = fragment[:, s].astype(np.int64) << 31 | fragment[:, e]
                else:
                    nothing = np.full(len(fragment), -1, np.int64)
                    front, rear = (codes.get(k, nothing) for k in ((s, m - 1), (s + 1, m - 1)))
                    # A phrase is named by the phrase without its last word, or without its first where that one is not this part's.
                    has_front = (e - 1 > SIDE) | ((e - 1 == SIDE) & ~after)
                    has_rear = s + 1 <= SIDE
                    alive &= ~has_front | (front >= 0)
                    if has_rear:
                        alive &= rear >= 0
                    key = np.where(has_front, front << 31 | fragment[:, e], (rear << 31 | fragment[:, s]) | 1 << 62)
                hit = np.flatnonzero(alive)
                keys.append(key[hit])
                at.append(hit)
                starts.append(np.full(len(hit), s))
            keys, at, starts = map(np.concatenate, (keys, at, starts))
            if not len(keys):
                break
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=n[at]).astype(np.int64)
            keep = (total >= least) | partial[at[first]]
            number = np.where(keep, np.cumsum(keep) - 1, -1)
            for s in np.unique(starts).tolist():
                codes[s, m] = np.full(len(fragment), -1, np.int64)
                codes[s, m][at[starts == s]] = number[place[starts == s]]
            phrase = np.full((int(keep.sum()), WIDTH), -1, np.int32)
            for k in range(m):
                phrase[:, k] = fragment[at[first[keep]], starts[first[keep]] + k]
            out.append(phrase)
            totals.append(total[keep])
            codes = {k: v for k, v in codes.items() if k[1] == m}
        phrases = np.concatenate(out) if out else np.zeros((0, WIDTH), np.int32)
        return pa.table([*(pa.array(phrases[:, k]) for k in range(WIDTH)), pa.array(np.concatenate(totals) if totals else np.zeros(0, np.int64))], names=[*WORDS, "a"])

    return run


def _padded(words: list[Column]) -> Column:
    """Words as one key."""
    return F.struct(*(c.alias(w) for w, c in zip(WORDS, [*words, *[F.lit(-1)] * (WIDTH - len(words))], strict=True)))


def phrase_counts(docs: DataFrame, least: int, lang_col: str, text_col: str, slice_bytes: int, part_fragments: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of at least ``least`` occurrences, all words of each language, phrases of at least ``least``)."""
    ship(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    base = durable(texts.mapInArrow(number_slices(slice_bytes), SLICES))
    books, data = base.where("codes is null"), base.where("codes is not null").select("slice", "codes")
    totals = durable(books.select("lang", F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    rows = books.select("slice", "lang", F.explode(F.arrays_zip("words", "numbers", "times")).alias("x")).select("slice", "lang", F.col("x.words").alias("word"), F.col("x.numbers").alias("number"), F.col("x.times").alias("n"))
    # One shuffle: a slice has a word once, so no word has more rows than there are slices. They are listed in blocks of so many slices.
    block = F.pmod(F.xxhash64("slice"), F.lit(1 + data.count() // 10_000)).alias("block")
    listed = rows.repartition("lang", "word").groupBy("lang", "word", block).agg(F.sum("n").alias("n"), F.collect_list(F.struct("slice", "number")).alias("places"))
    listed = durable(listed.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word"))).where(F.col("f") >= least).drop("n"))
    frequent = listed.groupBy("lang", "word").agg(F.first("f").alias("f"))
    size, number = frequent.agg(F.sum("f"), F.count("*")).first()
    # Dense ids: the place in one of so many buckets, and the bucket.
    buckets = max(1, number // 200_000)
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).cast("int")
    numbered = frequent.withColumn("bucket", bucket).withColumn("id", ((F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word")) - 1) * buckets + F.col("bucket")).cast("int"))
    words = durable(numbered.drop("bucket"))
    back = listed.drop("f").join(words, ["lang", "word"]).select("id", "f", "places").mapInArrow(hand_back(), KNOWN)
    parts = max(1, -(-(size or 0) // part_fragments))
    routed = durable(data.groupBy("slice").cogroup(back.groupBy("home")).applyInArrow(route(parts, hot), ROUTED))
    release(base, listed)
    # Classes of frequent pivots: whole where they are small enough, else dealt out by slice, and their counts are partial.
    classes = ["pivot", "beside", "mode"]
    split = routed.where("part is null")
    large = split.groupBy(*classes).agg(F.sum("rows").alias("all")).where(F.col("all") > hot)
    split = split.join(large, classes, "left").withColumn("partial", F.col("all").isNotNull())
    salt = F.when(F.col("partial"), F.pmod(F.xxhash64("fragments"), F.ceil(F.col("all") / hot))).otherwise(0)
    split = split.withColumn("part", F.pmod(F.xxhash64(*classes, salt), F.lit(parts)).cast("int"))
    columns = ["part", "mode", "partial", "fragments"]
    grouped = routed.where("part is not null").withColumn("partial", F.lit(False)).select(*columns).unionByName(split.select(*columns)).groupBy("part")
    phrases = durable(grouped.applyInArrow(mine(least), FOUND).groupBy(*WORDS).agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    release(routed)
    return words, totals, phrases


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", slice_bytes: int = 16 << 20, part_fragments: int = 200_000, hot: int = 300_000) -> DataFrame:
    """The first ``top`` phrases of two to five words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are numbered slice by slice. Their counts are added up and come back to the slices,
    so no dictionary of the corpus is held anywhere. Each slice then routes fragments, from
    which words under ``least`` are cut, to the part of their rarest word, and parts mine their
    phrases alone. Scores are exact whole numbers (decimals of 38 digits).

    Null text is empty, a null language is ``und``, repeated rows count as often as they
    come; a text of any length is read whole, and a piece may be as long as the text. Ties in
    score and count go by the bytes of the phrase. An empty table gives an empty result. No
    other column is read.
    """
    words, totals, phrases = phrase_counts(docs, least, lang_col, text_col, slice_bytes, part_fragments, hot)
    phrases = phrases.withColumn("key", F.struct(*WORDS)).withColumn("m", sum(F.when(F.col(w) >= 0, 1).otherwise(0) for w in WORDS))
    cols = [F.col(w) for w in WORDS]

    def by_length(f, least_m: int) -> Column:
        out = F.when(F.lit(False), f(least_m))
        for m in range(least_m, WIDTH + 1):
            out = out.when(F.col("m") == m, f(m))
        return out

    # A phrase inside a longer one of the same count is inside one that is longer by one word.
    inner = by_length(lambda m: F.array(_padded(cols[: m - 1]), _padded(cols[1:m])), 3)
    covers = phrases.where("m > 2").select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    left = phrases.join(covers, "key", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 100)).drop("longer")
    left = durable(left)

    counted = phrases.select("key", F.col("a").alias("f")).unionByName(words.select(_padded([F.col("id")]).alias("key"), "f"))
    cut = lambda m, k: F.array(*(F.struct(F.lit(k).alias("k"), F.lit(first).alias("first"), _padded(cols[:k] if first else cols[k:m]).alias("part")) for first in (True, False)))
    cuts = by_length(lambda m: F.concat(*(cut(m, k) for k in range(1, m))), 2)
    parts = left.select("key", "a", F.explode(cuts).alias("x")).select(F.col("key").alias("whole"), "a", "x.k", "x.first", F.col("x.part").alias("key")).join(counted, "key")
    sides = parts.groupBy("whole", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))

    spelled = left.select("key", F.posexplode(F.array(*cols)).alias("at", "id")).where("id >= 0").join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    scored = sides.join(spelled.withColumnRenamed("key", "whole"), "whole").join(totals, "lang").withColumn("top", whole("a") * 1000 * whole("n")).withColumn("under", whole("l") * whole("r"))
    scored = scored.withColumn("score", F.expr("top div under"))
    best = scored.groupBy("whole", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    # The first of each bucket, then the first of those.
    some = ranked(best.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64))), "bucket").drop("rank", "bucket")
    return ranked(some).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
