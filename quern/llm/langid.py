"""Language identification by unigram pieces, summed over all segmentations.

The pieces are the lower-case letter pieces of a fixed public vocabulary. A word is a run
of letters, lower-cased, after a U+2581; its probability in a language is the sum over
all ways to cut it into pieces of the product of the pieces' probabilities in that
language, by a forward recursion. A text's score is the product over its words; the
prediction is the language of the highest posterior under equal priors.

Piece probabilities are fitted by expectation maximisation, also over all segmentations,
on at most about SAMPLE_ROWS labelled rows of each language (chosen by a hash of doc_id;
the number of pieces times languages bounds the model, not the corpus). Training rows are
those with a language and crc32(doc_id as text) mod FOLDS other than HELD_OUT.

Defined results: a null text or one without letters gives ``und`` with score 0, and so do
all texts where there is nothing to learn from; equal scores go to the language that is
first in code-point order; a null doc_id counts as an empty string in the fold. A run of
over WORD_CHARS letters is cut every WORD_CHARS. Rows are independent of each other once
the model is fitted; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import map_batches, mix, powers, saved

SPACE = "▁"
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 2000
ROUNDS = 3
SMOOTHING = 0.1
WORD_CHARS = 40
PIECE_CHARS = 16
CACHE_WORDS = 1 << 16
#: Posterior under which a document counts as of no known language.
LEAST_SCORE = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    #: one row per piece and a last one for characters that no piece has, one column per language
    chances: np.ndarray


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Piece -> row, for the lower-case letter pieces of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(k) for k in range(len(sp)) if not (sp.is_control(k) or sp.is_byte(k) or sp.is_unknown(k)))
    kept = (p for p in found if p == SPACE or (p.removeprefix(SPACE).isalpha() and p == p.lower()))
    return {p: k for k, p in enumerate(p for p in kept if len(p) <= PIECE_CHARS)}


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased, cut to WORD_CHARS."""
    found = _LETTERS.findall((text or "").lower())
    if max(map(len, found), default=0) > WORD_CHARS:
        found = [w[k : k + WORD_CHARS] for w in found for k in range(0, len(w), WORD_CHARS)]
    return found


class Pieces:
    """The vocabulary by hashes of code points, one sorted table for each length."""

    def __init__(self, path: str):
        self.rows = vocabulary(path)
        by_length: dict[int, list] = {}
        for piece, row in self.rows.items():
            by_length.setdefault(len(piece), []).append((piece, row))
        self.tables = []
        for n in range(1, PIECE_CHARS + 1):
            found = by_length.get(n, [])
            total, _, down = _sums("".join(p for p, _ in found))
            at = np.arange(len(found)) * n
            hashes = mix((total[at + n] - total[at]) * down[at])
            order = np.argsort(hashes)
            maybe = np.zeros(1 << 16, bool)
            maybe[hashes & np.uint64(0xFFFF)] = True
            self.tables.append((hashes[order], np.array([r for _, r in found], np.int64)[order], maybe))

    def find(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of n characters, and their rows."""
        keys, rows, maybe = self.tables[n - 1]
        if not len(keys):
            return np.zeros(0, np.int64), rows
        left = np.flatnonzero(maybe[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(keys, hashes[left]), len(keys) - 1)
        hit = keys[at] == hashes[left]
        return left[hit], rows[at[hit]]


@lru_cache(maxsize=2)
def piece_tables(path: str) -> Pieces:
    return Pieces(path)


def _sums(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash over code points, and the powers that shift it back."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * up[: len(points)], out=total[1:])
    return total, points, down


def lattice(words: list[str], pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The arcs of all words: (start, length, words' indexes, pieces' rows), by start then length."""
    if not words:
        return []
    total, points, down = _sums("".join(SPACE + w for w in words))
    size = np.array([len(w) + 1 for w in words])
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    position = np.arange(len(points)) - begin[word]
    left = size[word] - position
    arcs = []
    for n in range(1, min(PIECE_CHARS, int(size.max())) + 1):
        at = np.flatnonzero(left >= n)
        hit, rows = pieces.find(mix((total[at + n] - total[at]) * down[at]), n)
        if n == 1:
            every = np.full(len(at), len(pieces.rows))
            every[hit] = rows
            hit, rows = np.arange(len(at)), every
        arcs.append((position[at[hit]] * (PIECE_CHARS + 1) + n, word[at[hit]], rows))
    order = np.argsort(keys := np.concatenate([a[0] for a in arcs]), kind="stable")
    keys, word, rows = keys[order], np.concatenate([a[1] for a in arcs])[order], np.concatenate([a[2] for a in arcs])[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
    return [(*divmod(int(keys[a]), PIECE_CHARS + 1), word[a:b], rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def forward(words: list[str], arcs: list, chances: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: the sum over the segmentations of each prefix."""
    size = max(map(len, words), default=0) + 2
    alpha = np.zeros((len(words), size, chances.shape[1]))
    alpha[:, 0] = 1
    for i, n, k, piece in arcs:
        alpha[k, i + n] += alpha[k, i] * chances[piece]
    return alpha


def word_scores(words: list[str], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """log P(word | language), summed over all segmentations; 0 for words without letters."""
    out = np.zeros((len(words), chances.shape[1]))
    for at in range(0, len(words), 8192):
        part = words[at : at + 8192]
        alpha = forward(part, lattice(part, pieces), chances)
        ends = alpha[np.arange(len(part)), [len(w) + 1 for w in part]]
        out[at : at + len(part)] = np.log(np.maximum(ends, 1e-300))
    out[[not any(c.isalpha() for c in w) for w in words]] = 0
    return out


def expected(words: list[str], weight: np.ndarray, language: np.ndarray, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language over all segmentations of the weighted words."""
    arcs = lattice(words, pieces)
    size = max(map(len, words), default=0) + 2
    alpha = np.zeros((len(words), size))
    beta = np.zeros((len(words), size))
    alpha[:, 0] = 1
    ends = np.array([len(w) + 1 for w in words])
    beta[np.arange(len(words)), ends] = 1
    for i, n, k, piece in arcs:
        alpha[k, i + n] += alpha[k, i] * chances[piece, language[k]]
    for i, n, k, piece in reversed(arcs):
        beta[k, i] += beta[k, i + n] * chances[piece, language[k]]
    scale = weight / np.maximum(alpha[np.arange(len(words)), ends], 1e-300)
    cell, uses = [], []
    for i, n, k, piece in arcs:
        cell.append(piece * chances.shape[1] + language[k])
        uses.append(alpha[k, i] * chances[piece, language[k]] * beta[k, i + n] * scale[k])
    if not cell:
        return np.zeros_like(chances)
    return np.bincount(np.concatenate(cell), np.concatenate(uses), chances.size).reshape(chances.shape)


def fold(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def sample(df: DataFrame, rows: int) -> DataFrame:
    """(lang, text) of about ``rows`` rows of each language at most, by a hash of doc_id."""
    labelled = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one small number per language
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return labelled.select("lang", "text")
    most = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, rows / n)])
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.filter(share < most[F.col("lang")]).select("lang", "text")


def fit(df: DataFrame, model_path: str, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """The piece probabilities of every language of df's labelled rows (doc_id, lang, text)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in words_of(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counted = map_batches(sample(df, rows), count, "lang string, word string, n long", "text")
    words = saved(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    size = len(vocabulary(model_path)) + 1
    chances = np.full((size, max(1, len(languages))), 1 / size)
    if not languages:
        return Model([], chances)
    index = {x: k for k, x in enumerate(languages)}

    for _ in range(rounds):
        now = chances

        def gather(batches, now=now):
            total, pieces = np.zeros_like(now), piece_tables(model_path)
            for batch in batches:
                lang, word, n = (batch.column(k).to_pylist() for k in range(3))
                for at in range(0, len(word), 4096):
                    part = slice(at, at + 4096)
                    total += expected(word[part], np.array(n[part], float), np.array([index[x] for x in lang[part]]), pieces, now)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language])], ["piece", "language", "uses"])

        uses = words.mapInArrow(gather, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
        # rounded, so that the order in which tasks are added doesn't show
        got = uses.select("piece", "language", F.round("uses", 6).alias("uses")).toArrow()
        total = np.zeros_like(chances)
        total[got["piece"].to_numpy(), got["language"].to_numpy()] = got["uses"].to_numpy()
        chances = (total + SMOOTHING) / (total.sum(axis=0) + SMOOTHING * size)
    return Model(languages, chances)


class Scorer:
    """Scores texts with one model, keeping the words already seen (at most CACHE_WORDS)."""

    def __init__(self, model: Model, model_path: str):
        self.model, self.pieces = model, piece_tables(model_path)
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.index) > CACHE_WORDS:
            self.index, self.scores = {}, self.scores[:0]
        new = list({w for words in split for w in words} - self.index.keys())
        if new:
            base = len(self.index)
            self.index.update((w, base + k) for k, w in enumerate(new))
            self.scores = np.concatenate([self.scores, word_scores(new, self.pieces, self.model.chances)])
        langs, scores = [], []
        for words in split:
            total = self.scores[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(axis=0)
            if not total.any():  # no letters
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(df: DataFrame, model: Model, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every text."""
    held: list[Scorer] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scorer(model, model_path))
        langs, scores = held[0](batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    made = map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), step, f"key {kind}, lang_pred string, score double", "text", 1 << 20)
    return made.withColumnRenamed("key", key)


def identify(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    model = fit(df.filter(fold() != HELD_OUT), model_path)
    keyed = df.select(F.struct("doc_id", (fold() == HELD_OUT).alias("held_out")).alias("key"), "text")
    got = predict(keyed, model, model_path, key="key")
    return got.select("key.doc_id", "key.held_out", "lang_pred", "score")


def accepted(df: DataFrame, model_path: str) -> DataFrame:
    """The documents of a known language, with df's columns: those with letters whose posterior is LEAST_SCORE or more."""
    model = fit(df.filter(fold() != HELD_OUT), model_path)
    at, held = df.columns.index("text"), []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scorer(model, model_path))
        langs, scores = held[0](batch.column(at).to_pylist())
        return batch.filter(pa.array([lang != UNKNOWN and score >= LEAST_SCORE for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return map_batches(df, step, ", ".join(f"`{n}` {t}" for n, t in df.dtypes), "text", 1 << 20)
