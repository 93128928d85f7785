"""Language identification by segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, which the
forward algorithm gives; a text's is the product over its words, and the
language with the largest one is predicted.  Piece probabilities come from
expectation maximisation over the words of a bounded sample of documents, one
Spark job a round; only sums per piece and language reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, text_batches

#: Documents that training takes, in expectation, of all languages together.
MAX_TRAIN = 8000
#: Words whose probabilities a worker keeps.
CACHE_WORDS = 400_000
#: Characters of words that one forward pass handles.
PASS_CHARS = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
START = "▁"
#: What is left for each character that no piece covers.
UNKNOWN = 1e-6
UNDETERMINED = "und"


def default_vocabulary() -> str:
    """Path of the public vocabulary that comes with the tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """Pieces of a SentencePiece model that are text; others become empty."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    return [model.id_to_piece(i) if plain(i) else "" for i in range(model.get_piece_size())]


class Lattice:
    """All cuts of words into pieces.

    Arcs are kept by (end, length); each word has one arc at most for such a
    pair, so a pass over words of similar length is a few array operations.
    A character that is no piece is covered by piece 0, the unknown one.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.longest = max(map(len, self.ids), default=1)
        self.starts = {p[:k] for p in self.ids for k in range(2, len(p) + 1)}

    def arcs(self, words: list[str]) -> tuple[int, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        get, starts = self.ids.get, self.starts
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        most = 0
        for n, word in enumerate(words):
            s = START + word
            size = len(s)
            most = max(most, size)
            for start in range(size):
                piece, end = get(s[start], 0), start + 1
                while True:
                    if piece is not None:
                        key = (end, end - start)
                        at = found.get(key)
                        if at is None:
                            at = found[key] = ([], [])
                        at[0].append(n)
                        at[1].append(piece)
                    end += 1
                    if end > size:
                        break
                    part = s[start:end]
                    if part not in starts:  # no piece goes on like this
                        break
                    piece = get(part)
        return most, {k: (np.array(w), np.array(p)) for k, (w, p) in found.items()}

    def passes(self, words: list[str]) -> Iterator[np.ndarray]:
        """Indexes of words of similar length, few enough for one pass."""
        order = np.argsort([len(w) for w in words], kind="stable")
        start, held = 0, 0
        for n, i in enumerate(order):
            held += len(words[i]) + 1
            if held > PASS_CHARS and n > start:
                yield order[start:n]
                start, held = n, len(words[i]) + 1
        if start < len(order):
            yield order[start:]

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words, languages): log of the sum over all cuts, with ``p`` the
        probability of (piece, language).  Rescaled every few characters.
        """
        out = np.empty((len(words), p.shape[1]))
        for at in self.passes(words):
            part = [words[i] for i in at]
            most, arcs = self.arcs(part)
            ring = self.longest + 1
            f = np.zeros((ring, len(part), p.shape[1]))
            f[0] = 1.0
            scale = np.zeros((len(part), p.shape[1]))
            ends = np.array([len(w) + 1 for w in part])
            for end in range(1, most + 1):
                now = np.zeros_like(f[0])
                for length in range(1, min(self.longest, end) + 1):
                    arc = arcs.get((end, length))
                    if arc is not None:
                        now[arc[0]] += f[(end - length) % ring, arc[0]] * p[arc[1]]
                f[end % ring] = now
                done = ends == end
                if done.any():
                    out[at[done]] = np.log(now[done]) + scale[done]
                if end % 8 == 0:
                    top = f.max(axis=0)
                    top[top <= 0] = 1.0
                    f /= top
                    scale += np.log(top)
        return out

    def expected(self, words: list[str], counts: np.ndarray, langs: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(pieces, languages): expected uses of each piece over all cuts of
        words that are each of one language.

        Both passes keep logarithms per position, so words may be of any
        length; within a position only ratios to the one beside it are used.
        """
        out = np.zeros(p.size)
        for at in self.passes(words):
            part, lang, n = [words[i] for i in at], langs[at], counts[at]
            most, arcs = self.arcs(part)
            ends = np.array([len(w) + 1 for w in part])
            ahead, back = np.zeros((most + 1, len(part))), np.zeros((most + 1, len(part)))
            weight = {k: p[piece, lang[w]] for k, (w, piece) in arcs.items()}
            for end in range(1, most + 1):
                now = np.zeros(len(part))
                for length in range(1, min(self.longest, end) + 1):
                    if (end, length) in arcs:
                        w = arcs[end, length][0]
                        now[w] += weight[end, length] * np.exp(ahead[end - length, w] - ahead[end - 1, w])
                ahead[end] = ahead[end - 1] + np.log(np.where(now > 0, now, 1.0))
            for start in range(most - 1, -1, -1):
                now = np.zeros(len(part))
                for length in range(1, min(self.longest, most - start) + 1):
                    if (start + length, length) in arcs:
                        w = arcs[start + length, length][0]
                        now[w] += weight[start + length, length] * np.exp(back[start + length, w] - back[start + 1, w])
                back[start] = back[start + 1] + np.log(np.where(now > 0, now, 1.0))
            total = ahead[ends, np.arange(len(part))]
            cells, uses = [], []
            for (end, length), (w, piece) in arcs.items():
                cells.append(piece * p.shape[1] + lang[w])
                uses.append(weight[end, length] * np.exp(ahead[end - length, w] + back[end, w] - total[w]) * n[w])
            if cells:
                out += np.bincount(np.concatenate(cells), np.concatenate(uses), minlength=p.size)
        return out.reshape(p.shape)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, pieces and the probability of (piece, language)."""

    languages: tuple[str, ...]
    pieces: list[str]
    p: np.ndarray


def _smoothed(counts: np.ndarray, weight: float = 50.0) -> np.ndarray:
    """Counts per language, backed off to the pooled and uniform ones."""
    pooled = counts.sum(axis=1) + 0.01
    back = (pooled / pooled.sum())[:, None]
    p = (counts + weight * back) / (counts.sum(axis=0) + weight)
    p[0] = UNKNOWN
    return p


def normal_words(text: str) -> list[str]:
    return text.lower().split()


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", may_learn: Column | None = None, vocabulary: str | None = None, max_train: int = MAX_TRAIN, rounds: int = 3) -> LanguageModel:
    """Fit on documents with a language and a text for which ``may_learn`` holds.

    Each language has an equal part of ``max_train``; of one with more
    documents about that many are taken, by hash of id and text, of one with
    fewer all.  Without documents there are no languages.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = docs.where(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.select(quoted(id_col).alias("_id"), quoted(lang_col).alias("_lang"), quoted(text_col).alias("_text"))
    sizes = known.groupBy("_lang").agg(F.count("*").alias("_n"))  # a row per language
    languages = tuple(sorted(r[0] for r in sizes.select("_lang").toLocalIterator()))
    pieces = read_pieces(vocabulary or default_vocabulary())
    if not languages:
        return LanguageModel((), pieces, np.zeros((len(pieces), 0)))
    part = -(-max_train // len(languages))
    draw = F.xxhash64("_id", "_text").bitwiseAND(F.lit(2**63 - 1)) / F.lit(float(2**63))
    known = known.join(F.broadcast(sizes), "_lang").where(draw * F.col("_n") < part)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                total.update((lang, w) for w in normal_words(text))
            if len(total) > 500_000:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "word", "n"])
                total.clear()
        if total:
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "word", "n"])

    words = known.select(F.col("_lang").alias("lang"), F.col("_text").alias("text")).mapInPandas(counted, "lang string, word string, n long")
    words = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(spark.sparkContext.defaultParallelism, "word"))
    number = {lang: i for i, lang in enumerate(languages)}
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((pieces, p))

        def expected(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            pieces, p = held.value
            lattice, total = Lattice(pieces), np.zeros_like(p)
            for pdf in batches:
                total += lattice.expected(pdf["word"].tolist(), pdf["n"].to_numpy(float), pdf["lang"].map(number).to_numpy(), p)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        counts = np.zeros_like(p)
        for r in words.mapInPandas(expected, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r[0], r[1]] = r[2]
        p = _smoothed(counts)
        held.unpersist()
    return LanguageModel(languages, pieces, p)


class Scorer:
    """Predicts texts; keeps the probabilities of common words."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.table = {}, self.table[:0]
        rows, get, fresh, docs = self.rows, self.rows.get, [], []
        for text in texts:
            if not self.model.languages or text is None or not LETTER.search(text):
                docs.append(None)
                continue
            at = []
            for w in normal_words(text):
                i = get(w)
                if i is None:
                    i = rows[w] = len(rows)
                    fresh.append(w)
                at.append(i)
            docs.append(at)
        if fresh:
            self.table = np.concatenate((self.table, self.lattice.log_probability(fresh, self.model.p)))
        langs, scores = [], []
        for at in docs:
            if at is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.table[at].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "prediction") -> DataFrame:
    """``docs`` with a struct (``out``) of ``lang`` and ``score``, the
    probability of that language given the text.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if no language was learned.  Ties go to the first language in
    code point order.  Only the text is read.
    """
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not scorers:
            scorers.append(Scorer(held.value))
        langs, scores = scorers[0].predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn(out, predict(quoted(text_col)))
