"""Operator 13 against a plain alignment, token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from matchforge.llm import alignment, queries
from matchforge.llm.tokenizers import path

FILES = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces ", "Tab\tnew\n\nline \r end", "naïve 日本語 🙂 ½", "<|endoftext|> and <s>", "▁ low line", "x" * 9000, "\x00\x1f\x85　 wide", "é combined   kept", "ｆｕｌｌ　width", "aaaa bbbb " * 50]


def plain(texts):
    """Rows by loops over all pairs of tokens in a group."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    # The letter of each byte is what the library itself shows for texts that hold the byte.
    letters = {}
    for c in [*map(chr, range(0x800)), *(chr(x << 12 | 0x7C0) for x in range(1, 16)), *(chr(x << 18) for x in range(1, 5)), "\U00010000"]:
        if (shown := "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c))) and len(shown) == len(c.encode()):
            letters.update(zip(shown, c.encode(), strict=True))

    def level(token):
        return bytes(letters[c] for c in token)


    def cut(text):
        if not text:
            return None
        whole = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False)
        a = [(i, level(t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None

    def spans(tokens):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    linked, count = [], Counter()
    for t in texts:
        got = cut(t)
        if got is None:
            linked.append(None)
            continue
        a, b = map(spans, got)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        links = []
        ia = ib = 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= c:
                ga.append(a[ia])
                ia += 1
            while ib < len(b) and b[ib][2] <= c:
                gb.append(b[ib])
                ib += 1
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        linked.append((len(a), len(b), groups, links))
        count.update(set(links))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    for x in linked:
        if x is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = x
            yield (n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op13_tokenizer_alignment(spark, sf).toPandas().sort_values("doc_id")
    docs = docs.sort_values("doc_id")
    assert [tuple(r) for r in got[COLUMNS].values.tolist()] == list(plain(docs.text.tolist()))


@pytest.mark.parametrize("size", [1, 1 << 25])
def test_alignment_odd(spark, size):
    texts = [*ODD, None, *ODD[:5]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
    got = alignment.align(docs, *FILES, slice_bytes=size).toPandas().sort_values("doc_id")
    want = list(plain(texts))
    assert [tuple(r) for r in got[COLUMNS].values.tolist()] == want
    assert want[7] == (0, 0, 0, 0, 0, 0, "") and want[6][0] > 0


def test_alignment_rows_of_any_kind(odd_documents, no_documents):
    got = alignment.align(odd_documents, *FILES)
    assert got.count() == odd_documents.count() and got.where("doc_id is null").count() == 1
    assert got.where("n_a = 0 and groups_sha256 = ''").count() == 2
    assert alignment.align(no_documents, *FILES).count() == 0


def test_bits():
    rng = np.random.default_rng(1)
    at = np.unique(rng.integers(0, 1000, 300))
    bits = alignment.Bits.at(at, 1000)
    assert bits.select().tolist() == at.tolist()
    q = np.arange(1001)
    assert bits.rank(q).tolist() == np.searchsorted(at, q).tolist()
    assert (bits & alignment.Bits.at(at[::2], 1000)).select().tolist() == at[::2].tolist()
