"""Operator 8: language identification with segmentation-marginalised unigrams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, durable, release, ship, slices

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Longer letter runs are summed over one at a time, by position; shorter ones many at a time.
LONG_WORD = 64
#: A worker remembers so many words at least, and as many more as fit two million numbers.
REMEMBERED = 20_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def text_words(text: str) -> list[str]:
    """Lower-case letter runs; a text without a letter has none."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def vocabulary(path: str) -> list[str]:
    """Letter pieces of a public vocabulary, lower-cased; a leading mark means a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p.removeprefix(START).isalpha())


class Lattice:
    """All segmentations of a batch of words over the vocabulary, found by rolling hashes.

    The table holds every beginning of every piece, so a search stops where no piece goes on.
    """

    def __init__(self, pieces: list[str]):
        begun = {p[:k]: -1 for p in pieces for k in range(1, len(p) + 1)} | {p: i for i, p in enumerate(pieces)}
        chars = np.zeros((len(begun) or 1, max(map(len, begun), default=1)), np.uint64)
        size = np.array([*map(len, begun)] or [1])
        chars[np.arange(chars.shape[1]) < size[:, None]] = np.frombuffer("".join(begun).encode("utf-32-le") or b"\0" * 4, "<u4")
        keys = np.zeros(len(chars), np.uint64)
        for j in range(chars.shape[1]):
            on = size > j
            keys[on] = (keys[on] ^ chars[on, j]) * _MULTIPLIER
            keys[on] ^= keys[on] >> np.uint64(29)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(begun.values()) or [-1])[order]
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)  # a character that no piece has

    def matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [START + w for w in words]
        length = np.array(list(map(len, cut)))
        chars = np.zeros((len(cut), int(length.max())), np.uint64)
        flat = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), "<u4")
        chars[np.arange(chars.shape[1]) < length[:, None]] = flat
        return chars, length

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece with each hash (-1: none), and whether a piece begins so."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == h
        return np.where(known, self.ids[at], -1), known

    def arcs(self, chars: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, words, piece ids) by start: words[i] has the piece between the two."""
        for start in range(chars.shape[1]):
            i = np.flatnonzero(length > start)
            h = np.zeros(len(i), np.uint64)
            stop = start
            while len(i):
                h = (h ^ chars[i, stop]) * _MULTIPLIER
                h ^= h >> np.uint64(29)
                stop += 1
                ids, known = self._find(h)
                hit = ids >= 0
                if stop == start + 1:
                    ids, hit = np.where(hit, ids, self.unknown), np.ones(len(i), bool)
                if hit.any():
                    yield start, stop, i[hit], ids[hit]
                on = known & (length[i] > stop)
                i, h = i[on], h[on]

    def positions(self, word: str) -> np.ndarray:
        """Pieces by length - 1 and place of their end in the marked word; -1 where there is none."""
        chars = self.matrix([word])[0][0]
        out = np.full((self.longest, len(chars) + 1), -1)
        h = np.zeros(len(chars), np.uint64)
        for k in range(min(self.longest, len(chars))):
            n = len(chars) - k
            h = (h[:n] ^ chars[k:]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            out[k, k + 1 :] = self._find(h)[0]
        first = out[0, 1:]
        first[first < 0] = self.unknown
        return out

    def _forward(self, word: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by position, and for each place and language the log of the sum over all ways there."""
        ids, k = self.positions(word), self.longest
        with np.errstate(divide="ignore"):
            logs = np.log(np.vstack([p, np.zeros((1, p.shape[1]))]))
        at = np.full((ids.shape[1] + k, p.shape[1]), -np.inf)  # k places before the start that nothing reaches
        at[k] = 0
        for stop in range(1, ids.shape[1]):
            ways = at[stop : stop + k][::-1] + logs[ids[:, stop]]
            top = ways.max(axis=0)
            at[stop + k] = top + np.log(np.exp(ways - top).sum(axis=0))
        return ids, at[k:]

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Words by languages: the log of the sum over all segmentations of the product of p."""
        out = np.zeros((len(words), p.shape[1]))
        for some in _batches(words):
            if len(words[some[0]]) > LONG_WORD:
                out[some[0]] = self._forward(words[some[0]], p)[1][-1]
                continue
            chars, length = self.matrix([words[k] for k in some])
            n, width = chars.shape
            alpha = np.zeros((width + self.longest + 1, n, p.shape[1]))
            alpha[0] = 1
            scale = np.zeros((n, p.shape[1]))
            done = -1
            for start, stop, i, ids in self.arcs(chars, length):
                if start != done and start % 8 == 0 and start:
                    ahead = slice(start, start + self.longest + 1)
                    top = alpha[ahead].max(axis=0)
                    top[top == 0] = 1
                    top[length <= start] = 1
                    alpha[ahead] /= top
                    scale += np.log(top)
                done = start
                alpha[stop, i] += alpha[start, i] * p[ids]
            out[some] = np.log(np.maximum(alpha[length, np.arange(n)], 1e-300)) + scale
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under p (one language), by the forward and backward sums."""
        out = np.zeros(len(p))
        for some in _batches(words):
            if len(words[some[0]]) > LONG_WORD:
                self._expected_long(words[some[0]], counts[some[0]], p, out)
                continue
            chars, length = self.matrix([words[k] for k in some])
            n, width = chars.shape
            arcs = list(self.arcs(chars, length))
            alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            alpha[0], beta[length, np.arange(n)] = 1, 1
            for start, stop, i, ids in arcs:
                alpha[stop, i] += alpha[start, i] * p[ids]
            for start, stop, i, ids in reversed(arcs):
                beta[start, i] += beta[stop, i] * p[ids]
            weight = counts[some] / np.maximum(beta[0], 1e-300)
            for start, stop, i, ids in arcs:
                out += np.bincount(ids, weight[i] * alpha[start, i] * p[ids] * beta[stop, i], len(p))
        return out

    def _expected_long(self, word: str, count: float, p: np.ndarray, out: np.ndarray) -> None:
        ids, ahead = self._forward(word, p[:, None])
        ahead, n, k = ahead[:, 0], ids.shape[1] - 1, self.longest
        with np.errstate(divide="ignore"):
            logs = np.log(np.append(p, 0.0))
        back = np.full(n + 1 + k, -np.inf)  # log of the sum over all ways from a place to the end
        back[n] = 0
        lengths = np.arange(1, k + 1)
        for start in range(n - 1, -1, -1):
            stop = np.minimum(start + lengths, n)
            ways = np.where(start + lengths <= n, logs[ids[lengths - 1, stop]] + back[start + lengths], -np.inf)
            top = ways.max()
            back[start] = top + np.log(np.exp(ways - top).sum())
        for j in range(min(k, n)):
            stops = np.flatnonzero(ids[j] >= 0)
            uses = np.exp(ahead[stops - j - 1] + logs[ids[j, stops]] + back[stops] - ahead[n])
            out += count * np.bincount(ids[j, stops], uses, len(out))


@lru_cache
def lattice_of(vocabulary_path: str) -> Lattice:
    """A worker's lattice over the vocabulary, built once."""
    return Lattice(vocabulary(vocabulary_path))


def _batches(words: list[str], cells: int = 40_000) -> Iterator[np.ndarray]:
    """Places of the words, those of like length together: as many as fit a matrix of ``cells``, long words alone."""
    size = np.array(list(map(len, words)))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        if size[order[at]] <= LONG_WORD:
            stop = min(at + 4_000, int(np.searchsorted(size[order], LONG_WORD, side="right")))
            while stop > at + 1 and (size[order[stop - 1]] + 1) * (stop - at) > cells:
                stop = at + max(1, (stop - at) // 2)
        yield order[at:stop]
        at = stop


def train(docs: DataFrame, vocabulary_path: str, rows_per_language: int = 2_000, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces + 1 by languages).

    Learned by expectation maximisation from all words of about ``rows_per_language`` whole
    texts of each language, drawn by a hash of the id (the documented bound). Tasks compute
    the expected uses of pieces, which are added up. Null texts and null languages are left
    out.
    """
    ship(docs.sparkSession)
    # Counting reads the narrow language column alone; texts are read once to learn and once to predict.
    sizes = {r["lang"]: r["n"] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("lang"), F.col(id_col)).alias("h")).where("lang is not null and text is not null")
    if not sizes:
        return [], np.zeros((0, 0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [text_words(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    langs, pieces = sorted(sizes), vocabulary(vocabulary_path)
    counted = drawn.mapInArrow(split, "lang string, words array<string>").select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = durable(counted)

    def expect(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, p = lattice_of(vocabulary_path), held.value
            out = np.zeros_like(p)
            for b in slices(batches, 8_192):
                for lang, part in b.to_pandas().groupby("lang", sort=False):
                    k = langs.index(lang)
                    out[:, k] += lattice.expected(part["word"].tolist(), part["n"].to_numpy(float), p[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(list(out))], names=["piece", "uses"])

        return run

    table = np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1))
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(table)
        uses = counted.mapInArrow(expect(held), "piece long, uses array<double>")
        sums = uses.groupBy("piece").agg(*(F.sum(F.col("uses")[k]).alias(f"u{k}") for k in range(len(langs)))).toPandas()
        table = np.zeros((len(pieces) + 1, len(langs)))
        if len(sums):
            table[sums["piece"].to_numpy()] = sums.drop(columns="piece").to_numpy()
        table += 0.01
        table /= table.sum(axis=0)
    release(counted)
    return langs, table


def _predictor(langs: list[str], table, vocabulary_path: str):
    """A function from texts to (language, score) that remembers words; one for each task."""
    lattice, p = lattice_of(vocabulary_path), table
    known: dict[str, int] = {}
    scores = np.zeros((max(REMEMBERED, 2_000_000 // max(1, len(langs))), len(langs)))

    def predict(raw: list[str | None]) -> tuple[list[str], list[float]]:
        nonlocal known, scores
        texts = [text_words(t) if t and langs else [] for t in raw]
        new = list({w for ws in texts for w in ws}.difference(known))
        if len(known) + len(new) > len(scores):
            known, new = {}, list({w for ws in texts for w in ws})
            if len(new) > len(scores):
                scores = np.zeros((len(new), len(langs)))
        if new:
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            scores[at : at + len(new)] = lattice.log_probability(new, p)
        preds, sure = [], []
        for ws in texts:
            if not ws:
                preds.append("und")
                sure.append(0.0)
                continue
            s = scores[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            k = int(s.argmax())
            preds.append(langs[k])
            sure.append(float(1 / np.exp(s - s[k]).sum()))
        return preds, sure

    return predict


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each whole text, in one pass without a shuffle.

    A text's log probability in a language is the sum over its words of the word's forward
    sum; score is the best language's posterior under equal priors. Null texts and texts
    without a letter, and all texts if no language was learned, are ``und`` with score 0.
    A tie goes to the first language by code point.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(langs, held.value, vocabulary_path)
        for b in slices(batches):
            preds, sure = predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(preds, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, langs: list[str], table: np.ndarray, vocabulary_path: str, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language with at least this score."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(langs, held.value, vocabulary_path)
        for b in slices(batches):
            preds, sure = predict(b.column(at).to_pylist())
            yield b.filter(pa.array([k != "und" and s >= least for k, s in zip(preds, sure, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label(docs: DataFrame, vocabulary_path: str, fold: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Rows whose crc32(id) mod ``fold`` is 0 are never learned from.

    Null, empty and blank texts and texts without a letter are ``und`` with score 0; so are all
    texts if no row names a language to learn. Rows with a null id are neither learned from nor
    held out. Repeated rows count and are labelled as often as they come; equal texts get equal
    labels, and a tie goes to the first language by code point. Texts, words and pieces of any
    length are summed over whole. Other columns are not read. An empty table gives an empty
    result.
    """
    mod = crc_mod("doc_id", fold)
    langs, table = train(docs.where(mod != 0), vocabulary_path)
    out = identify(docs, langs, table, vocabulary_path)
    return out.select("doc_id", F.coalesce(mod == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
