"""Operator 1: near-duplicate groups by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary, durable, release, ship, slices

#: Shingles whose permutations are computed at once.
BLOCK = 4_096
#: A pair at the threshold shares no band with this probability.
MISSED = 1e-6
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Bits of the map of candidate texts: its size is the same for any input.
MAP_BITS = 24
#: A signature's sketch has one bit of each of its first values.
SKETCH_BITS = 256
#: In open buckets, shingles of at most so many classes are rare.
RARE = 8
#: Members that share a hub are dealt to so many parts.
SALTS = 64
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; one for a text of fewer words, none without words."""
    ws = text.lower().split()  # on bytes: A-Z alone, and cut at space and 9 to 13
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - width + 1
    key = h[:n].copy()
    for k in range(1, width):
        key *= _MIX[0]
        key ^= key >> np.uint64(29)
        key += h[k : n + k]
    key *= _MIX[1]
    key ^= key >> np.uint64(32)
    return np.unique(key)


def plan_bands(threshold: float, rows: int) -> int:
    """Bands of ``rows`` values such that a pair at the threshold is missed with probability ``MISSED``; even in all values."""
    n = math.ceil(math.log(MISSED) / math.log(1 - threshold**rows))
    return n + (n * rows) % 2


class MinMax:
    """Signatures: the least and the largest value under each permutation, so half as many permutations as values."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 1 << 31, bands * rows // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        # Each band draws from both ends of permutations of its own.
        self.order = rng.permutation(bands * rows)

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit key for each set and band, and the sketches. Sets must not be empty."""
        sizes = np.array(list(map(len, sets)))
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        low = np.full((len(sets), len(self.factor)), np.iinfo(np.uint32).max, np.uint32)
        high = np.zeros_like(low)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(flat):
            stop = min(at + BLOCK, len(flat))
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, stop - 1, side="right")
            cuts = np.concatenate([[0], ends[first:last] - at])
            values = flat[at:stop, None] * self.factor
            some = slice(first, last + 1)
            low[some] = np.minimum(low[some], np.minimum.reduceat(values, cuts))
            high[some] = np.maximum(high[some], np.maximum.reduceat(values, cuts))
            at = stop
        values = np.concatenate([low, high], axis=1)[:, self.order]
        bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
        used = min(SKETCH_BITS, values.shape[1])
        bits[:, :used] = (values[:, :used] * np.uint32(0x9E3779B1)) >> np.uint32(31)
        sketch = np.packbits(bits, axis=1).view(np.int64)
        values = values.reshape(len(sets), self.bands, self.rows)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64) * _MIX[1], (len(sets), self.bands)).copy()
        for k in range(self.rows):
            key = (key ^ values[:, :, k]) * _MIX[0]
            key ^= key >> np.uint64(31)
        return key.view(np.int64), sketch


def sketch_limit(threshold: float, values: int) -> int:
    """Differing sketch bits that a pair at the threshold exceeds with a probability of about 1e-10."""
    used = min(SKETCH_BITS, values)
    differ = (1 - threshold) / 2
    return math.floor(used * differ + 6.4 * math.sqrt(used * differ * (1 - differ)))


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signatures(width: int, bands: int, rows: int):
    """For mapInArrow: (doc_id, text, text_hash) to the set's size, its fingerprint, its band keys and its sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minmax = WordHashes(), MinMax(bands, rows)
        for b in slices(batches, 128):
            sets = [shingle_set(t, width, hashes) for t in binary(b.column("text"))]
            full = [s for s in sets if len(s)]
            keys, found = minmax.keys(full) if full else (np.zeros((0, bands), np.int64), np.zeros((0, len(SKETCH)), np.int64))
            sketch = np.zeros((len(sets), len(SKETCH)), np.int64)
            sketch[[k for k, s in enumerate(sets) if len(s)]] = found
            offsets = np.cumsum([0, *(bands * bool(len(s)) for s in sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, keys.ravel()), *map(pa.array, sketch.T.copy())], names=["doc_id", "text_hash", "n_shingles", "fp", "bands", *SKETCH])

    return run


def _sets(width: int):
    """For mapInArrow: texts to fingerprints and full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, 128):
            sets = [shingle_set(t, width, hashes).astype(np.int64) for t in binary(b.column("text"))]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *sets]))], names=["fp", "shingles"])

    return run


def candidate_sets(texts: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) once for each candidate class.

    Only texts that may be a candidate's reach Python: a map of 2**MAP_BITS bits over text
    hashes, built by an aggregate, goes to all workers. Its size (at most 2**MAP_BITS / 64
    rows of two longs) does not depend on the input; the more candidates, the less it spares.
    """
    bit = F.shiftrightunsigned("text_hash", 64 - MAP_BITS)
    word, mask = F.shiftright(bit, 6), F.expr("shiftleft(1L, int(bit & 63))")
    bits = candidates.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    rows = texts.withColumn("bit", bit).withColumn("word", word).join(F.broadcast(bits), "word").where(F.expr("(mask & shiftleft(1L, int(bit & 63))) != 0"))
    found = rows.select("text").mapInArrow(_sets(width), "fp binary, shingles array<long>")
    return found.join(candidates.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    x = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
    x = x.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def starlike(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b) is tied to one other at most, and none is tied that others are tied to."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre"))
    return nodes.agg(F.count_if(F.col("tied") + F.col("centre") > 1)).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a of the edges (a, b) that reaches a lesser one: b is the least node reached.

    Alternates large-star and small-star steps, each a group-by on narrow rows, until all
    edges are stars around their least nodes, which is tried before each round: links that
    are stars already cost one look. A star's centre is found by a combining aggregate, so a
    hub of any degree is fine.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    while not starlike(now):
        # Large star: each neighbour that is larger than a node is tied to the node's least neighbour.
        both = now.union(now.select("b", "a")).toDF("n", "v")
        least = both.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where(F.col("v") > F.col("n")).join(least, "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours, and itself, are tied to the least of them.
        large = durable(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where(F.col("a") != F.col("b")).distinct()
        old, now = now, durable(small)
        release(old, large)
    return now


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (fp, root) after more links; roots and classes without a link have no row."""
    if labels is None:
        return components(links).toDF("fp", "root")
    a, b = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    # Only roots move, and they have no row yet.
    merged = components(lifted).toDF("old", "new")
    out = durable(labels.join(merged, F.col("root") == F.col("old"), "left").select("fp", F.coalesce("new", "root").alias("root")).union(merged))
    release(labels, merged)
    return out


def opened(rest: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (fp, bucket) of ``rest`` with what is known of the class, and before: its buckets there of lesser bands.

    Two classes of different components meet in no bucket that isn't in ``rest``, so these say
    whether a pair has met before as well as all band keys do, and the rows are no wider.
    """
    own = rest.groupBy("fp").agg(F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("band", "bucket", "members"))).alias("open"))
    rows = own.join(known, "fp").select("*", F.posexplode("open").alias("at", "here"))
    return rows.select(*own.columns[:2], *known.drop("fp").columns, "here.bucket", "here.members", F.slice("open.bucket", F.lit(1), F.col("at")).alias("before"))


def near_classes(classes: DataFrame, texts: DataFrame, width: int, percent: int, most_bits: int) -> DataFrame:
    """(fp, root) of the classes that are linked to a lesser one, the root. classes: fp, text_hash, n_shingles, bands and the sketch.

    A bucket (classes with one band key) never gives all its pairs. First each class is held
    against the least class of one of its buckets, then against those of all its buckets;
    links join components. Only buckets that still hold several components go on: there a
    few classes, and at last all, are held against members of other components. Pairs must
    pass two tests inside the join: without shingles that are rare in these buckets, the
    similarity is still possible (which is exact, as pairs that share a rare one are held
    against each other before), and sketches differ in at most ``most_bits`` bits. So a
    bucket of copies costs its size, not its square, and edited copies that are too far from
    all others, or documents that share a passage, give hardly a row.
    """
    about = classes.select("fp", F.col("n_shingles").cast("int").alias("n"), F.col("n_shingles").cast("int").alias("all"), *SKETCH)
    bucketed = classes.select("fp", F.posexplode("bands").alias("band", "bucket"))
    hubs = bucketed.groupBy("bucket").agg(F.min("fp").alias("hub"), F.count("*").alias("members")).where("members > 1")
    met = durable(bucketed.join(hubs, "bucket").select("bucket", "band", "fp", "hub", F.col("members").cast("int").alias("members")))
    candidates = durable(classes.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", "text_hash", F.col("n_shingles").cast("int").alias("all"), *SKETCH))
    sets = durable(candidate_sets(texts, candidates, width))

    def side(rows: DataFrame, key: str, suffix: str) -> DataFrame:
        return rows.join(about.select(F.col("fp").alias(key), *(F.col(c).alias(c + suffix) for c in ("n", "all", *SKETCH))), key)

    def near(rows: DataFrame, more: Column = F.lit(True)) -> DataFrame:
        bits = sum((F.bit_count(F.col(c + "_a").bitwiseXOR(F.col(c + "_b"))) for c in SKETCH[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
        # n is what a class may share with others; of all its shingles where that isn't known yet.
        most = F.least("n_a", "n_b")
        rows = rows.where((100 * most >= percent * (F.col("all_a") + F.col("all_b") - most)) & (bits <= most_bits) & more)
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def starred(rows: DataFrame) -> DataFrame:
        return near(side(side(rows, "a", "_a"), "b", "_b"))

    first = met.where("fp != hub").groupBy("fp").agg(F.min("hub").alias("b")).withColumnRenamed("fp", "a")
    links = durable(confirm(starred(first), sets, percent))
    labels = _relabel(None, links)
    release(links)

    def split(rows: DataFrame) -> DataFrame:
        """Members of buckets with several components, with their component."""
        rows = rows.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
        return rows.join(several.select("bucket"), "bucket", "left_semi")

    rest = durable(split(met))
    release(met)
    # A hub of many buckets has a copy of its label for each of SALTS parts of its members.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    roots = labels.toDF("hub", "hub_root").join(rest.select("hub").distinct(), "hub", "left_semi").select("hub", "hub_root", salts)
    cross = rest.withColumn("salt", F.pmod(F.xxhash64("fp", "bucket"), F.lit(SALTS)).cast("int")).join(roots, ["hub", "salt"], "left").where(F.coalesce("hub_root", "hub") != F.col("root"))
    links = durable(confirm(starred(cross.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()), sets, percent))
    if links.take(1):
        labels = _relabel(labels, links)
    release(links)
    rest = durable(split(rest.select("bucket", "band", "fp", "members")))
    # Pairs that share a rare shingle are listed from those; all others can't count their rare ones.
    held = sets.join(rest.select("fp").distinct(), "fp", "left_semi").select("fp", F.explode("shingles").alias("x"))
    few = durable(held.join(held.groupBy("x").agg(F.count("*").alias("k")).where(F.col("k") <= RARE), "x"))
    known = durable(candidates.drop("text_hash").join(few.groupBy("fp").agg(F.count("*").cast("int").alias("own")), "fp", "left").withColumn("n", F.col("all") - F.coalesce("own", F.lit(0))).drop("own"))
    together = few.where("k > 1").groupBy("x").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b").distinct()
    root = lambda c: labels.toDF(c, f"root_{c}")
    apart = together.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = durable(confirm(starred(apart), sets, percent))
    if links.take(1):
        labels = _relabel(labels, links)
    release(links, few)
    # A class's place in its bucket says in which round it is held against the others; a pair
    # is tried in the first bucket that it shares and in no other.
    place = F.shiftrightunsigned(F.xxhash64("bucket", "fp"), 11) / float(1 << 53) * F.col("members")
    for hubs_only in (True, False):
        old = rest
        rest = durable(split(rest.select("bucket", "band", "fp", "members")))
        release(old)
        x = opened(rest, known).withColumn("first", place < 16)
        a, b = (x.where(F.col("first") if hubs_only and c == "a" else F.lit(True) if hubs_only else ~F.col("first")).select("bucket", F.col("fp").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("root", "n", "all", "before", "first", *SKETCH))) for c in "ab")
        once = (F.col("a") < F.col("b")) | (~F.col("first_b") if hubs_only else F.lit(False))
        links = durable(confirm(near(a.join(b, "bucket").where((F.col("root_a") != F.col("root_b")) & once), ~F.arrays_overlap("before_a", "before_b")), sets, percent))
        if links.take(1):
            labels = _relabel(labels, links)
        release(links)
    release(known)
    release(rest, candidates, sets)
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_hash.

    Words are lower-cased (A-Z) and split at white space; a document is its set of ``width``
    word shingles, or its whole sequence if it has fewer words. Documents whose sets share at
    least ``percent`` of their union are linked, as confirmed on the full sets;
    component_id is the least id that links reach. Rows with equal sets form a class and are
    compared once, so copies cost nothing further.

    A row without words (null or blank text) is linked with nothing and kept. A text of any
    length is taken whole, and signed in blocks. A null id is never the least of a component
    with a real one. Of equal ids the rows stay or go by their texts. Rows that repeat id and text share a
    class, and stay or go together. An empty table gives an empty result. No other column is
    read.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    bands = plan_bands(percent / 100, rows)
    signed = durable(texts.mapInArrow(_signatures(width, bands, rows), "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)))
    narrow = signed.select("doc_id", "n_shingles", "fp", "text_hash")
    full = signed.where("n_shingles > 0")
    # Band keys and sketch are functions of the set, so any row of a class will do.
    classes = durable(full.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", *SKETCH))))
    labels = near_classes(classes, texts, width, percent, sketch_limit(percent / 100, bands * rows))
    rooted = classes.select("fp", "least").join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("root", "component_id")
    final = durable(rooted.join(linked, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = narrow.join(final, "fp", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``near_duplicates`` keeps: one document of each group."""
    fallen = near_duplicates(docs, width, percent, rows, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    every = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return every.join(fallen, every["id"].eqNullSafe(fallen["id"]) & (every["text_hash"] == fallen["text_hash"]), "left_anti").select("row.*")
