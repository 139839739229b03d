"""Operator 4 against brute-force counts, a true model of the mix, and held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np

from matchforge.llm import lm_scoring
from matchforge.llm.common import WordHashes


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def trains(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def check_base(rows, got):
    c = Counter(x for i, t in rows if trains(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), not trains(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want


def test_base_and_held_out(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm_scoring.score(docs).collect()
    check_base(rows, got)
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    monkeypatch.setattr(lm_scoring, "COMMON", 50)  # most words go by the join
    check_base(rows, lm_scoring.score(docs).collect())


def test_odd(odd_documents, no_documents):
    check_base([(r["doc_id"], r["text"]) for r in odd_documents.collect()], lm_scoring.score(odd_documents).collect())
    assert lm_scoring.score(no_documents).count() == 0


def test_filter_never_under_counts(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    n = rng.geometric(0.2, len(keys))
    counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys.view(np.int64), n, strict=True)], "key long, n long")
    f = lm_scoring.Filter(lm_scoring.build_filter(counts, 3))
    got, want = f.levels(keys), np.where(n >= 3, lm_scoring.level_of(n), 0)
    assert (got >= want).all() and (got != want).mean() < 0.01
    assert (f.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.01


def test_mix_is_a_probability():
    """Over all known words and the unseen class, one context's probabilities sum to at most about one."""

    class Exact:
        def __init__(self, held):
            self.held = held

        def levels(self, keys):
            return np.array([self.held.get(int(k), 0) for k in keys])

    text = b"a b a c a b d a b a b c"
    h = WordHashes()
    t = lm_scoring.token_hashes(text, h)
    words, pairs = lm_scoring.gram_keys([t])
    counts = Counter(words.tolist()) + Counter({k: c for k, c in Counter(pairs.tolist()).items() if c > 1})
    m = lm_scoring.Model(np.zeros(lm_scoring.REGIONS, np.uint8), {(o, j): float(j) for o in (0, 1) for j in range(20)}, len(t), 0.05)
    m.filter = Exact(dict(counts))
    first = lm_scoring.token_hashes(b"a", h)[0]
    total = 0
    for w in [*(lm_scoring.token_hashes(x, h)[0] for x in (b"a", b"b", b"c", b"d", b"unknown")), lm_scoring.END]:
        full, _ = m.log_probabilities([np.array([first, w])])
        total += 10 ** full[1]
    assert (total <= 1 + 1e-9).all() and (total > 0.5).all()


def test_pairs_seen_once_count(spark):
    """Every pair of a training text is seen once; the held-out text with its words turned round must score less."""
    rows = [(i, f"one{i} two{i} three{i}") for i in range(200) if trains(i)]
    held = [i for i in range(1000, 3000) if not trains(i)][: len(rows)]
    twice = [(h, t) for h, (_, t) in zip(held, rows)] + [(h + 10_000, " ".join(reversed(t.split()))) for h, (_, t) in zip(held, rows) if not trains(h + 10_000)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()}
    pairs = [(got[h], got[h + 10_000]) for h in held if h + 10_000 in got]
    assert len(pairs) > 10 and np.mean([a > b for a, b in pairs]) > 0.9


def test_slices_and_parts_change_no_score(spark, monkeypatch):
    """However little a slice and a part hold, every key is counted and scored alike."""
    docs = spark.createDataFrame([(i, f"one{i} two{i % 7} three{i % 3}") for i in range(200)], "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 200)
    monkeypatch.setattr(lm_scoring, "PART_KEYS", 20)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    assert np.isclose([got[i] for i in want], list(want.values())).mean() > 0.95


def test_a_filter_grows_with_its_entries():
    keys = np.random.default_rng(3).integers(0, 1 << 64, 300_000, dtype=np.uint64)
    few, many = (lm_scoring.sized_filter(k, np.ones(len(k), np.int64)) for k in (keys[:1000], keys))
    assert many.bits.size > 10 * few.bits.size and all((f.levels(k) == 1).mean() > 0.99 for f, k in ((few, keys[:1000]), (many, keys)))
