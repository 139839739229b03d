"""Operator 12 against plain counting, with the hot paths forced."""

import random
import re
from collections import Counter, defaultdict

import pytest

from matchforge.llm import collocations


def plain(rows, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                counts[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + j] for p, a in found.items() for j in range(2, len(p)) for i in range(len(p) - j + 1) if a >= c[p[i : i + j]]}
        best = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "The", "a", "b", "né", "日本", "x1", "q\x85q", *(f"w{i}" for i in range(30))]
    weights = [200, 150, 50, 80, 70, 40, 30, 20, 10, *(40 / (i + 1) for i in range(30))]
    rows = []
    for _ in range(n):
        ws = rng.choices(words, weights, k=rng.randint(0, 60))
        if rng.random() < 0.4:
            ws += ["new", "york", "stock", "exchange", "news"]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! "]) for w in ws)))
    return [*rows, ("en", None), ("de", ""), (None, " . \t,"), ("en", "the of " * 3000), ("en", "the the the the the the " * 50)]


@pytest.mark.parametrize(("slice_bytes", "part_fragments", "hot"), [(1 << 20, 1 << 20, 1 << 20), (2000, 500, 300), (3000, 200, 20)])
def test_collocations(spark, slice_bytes, part_fragments, hot):
    rows = texts(5, 400)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, n int").repartition(3)
    for least, top in ((20, 2000), (5, 30)):
        got = collocations.collocations(docs, least, top, slice_bytes=slice_bytes, part_fragments=part_fragments, hot=hot).collect()
        want = plain(rows, least, top)
        assert sorted(map(tuple, got)) == want
        assert len(want) > 50


def test_collocations_odd(odd_documents, no_documents):
    assert collocations.collocations(no_documents, 2).count() == 0
    got = collocations.collocations(odd_documents, 2).collect()
    assert sorted(map(tuple, got)) == plain([(r["lang"], r["text"]) for r in odd_documents.collect()], 2, 2000)


def test_scores_pass_64_bits(spark):
    """a * n * 1000 of a large corpus, by the same expression."""
    row = spark.sql("select cast(4000000000000 as decimal(38,0)) * 1000 * cast(20000000000000 as decimal(38,0)) div (cast(5000000000000 as decimal(38,0)) * cast(4000000000000 as decimal(38,0))) as x").first()
    assert row["x"] == 1000 * 4 * 10**12 * 2 * 10**13 // (5 * 10**12 * 4 * 10**12)
