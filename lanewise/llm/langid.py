"""Language identification with unigram piece models summed over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, found by a forward pass; a text's is
the product over its words and the language's prior. The probabilities come from a few rounds of
expectation maximisation with the same lattice.

Words are maximal runs of letters, lower-cased, with the vocabulary's word-start mark in front.
Runs of more than ``STRETCH`` letters are scored in stretches of that length, so the lattice of
one word is bounded while the whole text counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import mix64
from lanewise.session import stored

START = "▁"
STRETCH = 32
LONGEST_PIECE = 16
CACHE_WORDS = 200_000
SLICE_WORDS = 200_000
UNKNOWN_CHAR = 1e-7
_RUNS = re.compile(r"[^\W\d_]+")


@dataclass
class PieceModel:
    """``probs[piece, language]``, language names in order, and their log priors."""

    pieces: list[str]
    languages: list[str]
    probs: np.ndarray
    log_prior: np.ndarray


def letter_words(text: str | None) -> list[str]:
    """Words of a text; null, empty and letterless texts have none."""
    words = []
    for run in _RUNS.findall(text.lower()) if text else ():
        if not run.isalpha():  # number-like signs that the pattern lets through
            run = "".join(c if c.isalpha() else " " for c in run)
        for word in run.split():
            words.extend(word[i : i + STRETCH] for i in range(0, len(word), STRETCH))
    return words


def read_pieces(model_path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece file, with or without the word start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted(
        {
            p
            for p in found
            if p.removeprefix(START).isalpha() and p == p.lower() and len(p) <= LONGEST_PIECE
        }
    )


class Lattice:
    """Piece lookups for words of equal length at a time, so that each pass is vectorised."""

    def __init__(self, pieces: list[str]):
        hashes = np.zeros(len(pieces), np.uint64)
        lengths = np.array([len(p) for p in pieces])
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            hashes[same] = self._hashes(*[pieces[k] for k in same])[:, 0, -1]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(pieces):
            raise ValueError("two pieces have one hash")
        self.none = len(pieces)

    @staticmethod
    def _hashes(*words: str) -> np.ndarray:
        """64-bit hashes ``[word, start, length - 1]`` of the substrings of words of equal length."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        chars = mix64(chars.astype(np.uint64) + np.uint64(1))
        n = chars.shape[1]
        sizes = min(n, LONGEST_PIECE)
        out = np.zeros((len(words), n, sizes), np.uint64)
        run = np.zeros((len(words), n), np.uint64)
        for size in range(sizes):
            last = n - size
            run = run[:, :last] * np.uint64(0x9E3779B97F4A7C15) + chars[:, size:]
            out[:, :last, size] = run
        return out

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per word length: positions in ``words`` and the ids ``[word, start, length - 1]``."""
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(len(word), []).append(k)
        for members in groups.values():
            step = max(1, 2048 * 16 // (len(words[members[0]]) + 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                hashes = self._hashes(*[START + words[k] for k in part])
                place = np.searchsorted(self.hashes, hashes.ravel()).clip(max=self.none - 1)
                ids = np.where(self.hashes[place] == hashes.ravel(), self.order[place], self.none)
                yield np.array(part), ids.reshape(hashes.shape)

    def arcs(self, ids: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Arc probabilities; a character that no piece covers alone keeps a floor."""
        arcs = probs[ids]
        arcs[:, :, 0] = np.maximum(arcs[:, :, 0], UNKNOWN_CHAR)
        return arcs

    @staticmethod
    def forward(arcs: np.ndarray) -> np.ndarray:
        """Sum over segmentations of every prefix: ``[word, position, ...]``."""
        words, n, sizes = arcs.shape[:3]
        alpha = np.zeros((words, n + 1, *arcs.shape[3:]))
        alpha[:, 0] = 1.0
        for i in range(n):
            for size in range(1, min(sizes, n - i) + 1):
                alpha[:, i + size] += alpha[:, i] * arcs[:, i, size - 1]
        return alpha

    @staticmethod
    def backward(arcs: np.ndarray) -> np.ndarray:
        words, n, sizes = arcs.shape[:3]
        beta = np.zeros((words, n + 1, *arcs.shape[3:]))
        beta[:, n] = 1.0
        for i in range(n - 1, -1, -1):
            for size in range(1, min(sizes, n - i) + 1):
                beta[:, i] += beta[:, i + size] * arcs[:, i, size - 1]
        return beta


def _with_none(probs: np.ndarray) -> np.ndarray:
    return np.vstack([probs, np.zeros((1, probs.shape[1]))])


def _expected(lattice: Lattice, words: list[str], times: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over the segmentations of the words."""
    counts = np.zeros(lattice.none + 1)
    for part, ids in lattice.by_length(words):
        arcs = lattice.arcs(ids, probs)
        alpha, beta = lattice.forward(arcs), lattice.backward(arcs)
        weight = times[part] / alpha[:, -1]
        sizes, n = ids.shape[2], ids.shape[1]
        for size in range(1, sizes + 1):
            last = n - size + 1
            uses = alpha[:, :last] * arcs[:, :last, size - 1] * beta[:, size:] * weight[:, None]
            counts += np.bincount(ids[:, :last, size - 1].ravel(), uses.ravel(), len(counts))
    return counts[:-1]


def fit(
    labelled: DataFrame,
    pieces: list[str],
    text: str = "text",
    lang: str = "lang",
    order: str = "doc_id",
    sample_per_lang: int = 400,
    rounds: int = 3,
    smoothing: float = 0.05,
    max_languages: int = 1000,
) -> PieceModel:
    """Fit on a bounded sample of the labelled rows: about ``sample_per_lang`` of each language.

    A row is in the sample when its hashed ``order`` column falls under the language's rate, so
    the sample needs no sort and reruns agree. Priors count all labelled rows. Rows without text
    or label teach nothing; no labelled rows give a model without languages.
    """
    rows = labelled.select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
        ((F.xxhash64(order) % 1_000_003 + 1_000_003) % 1_000_003).alias("draw"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels; is this a language column?")
    names, spark = sorted(sizes), labelled.sparkSession
    if not names:
        return PieceModel(pieces, [], np.zeros((len(pieces), 0)), np.zeros(0))
    rate = F.create_map(
        *[F.lit(x) for k in names for x in (k, min(1_000_003, sample_per_lang * 1_000_003 // sizes[k] + 1))]
    )
    sample = rows.where(F.col("draw") < rate[F.col("lang")])

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter((lang, w) for lang, t in zip(batch["lang"], batch["text"]) for w in letter_words(t))
            yield pd.DataFrame({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())})

    words = stored(
        sample.select("lang", "text")
        .mapInPandas(count_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .repartition(spark.sparkContext.defaultParallelism),
        "langid-words",
    )
    column = {k: i for i, k in enumerate(names)}
    probs = np.full((len(pieces), len(names)), 1.0 / len(pieces))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, probs))

        def step(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            pieces, probs = sent.value
            lattice, probs = Lattice(pieces), _with_none(probs)
            total = np.zeros((len(pieces), len(column)))
            for batch in batches:
                for name, part in batch.groupby("lang"):
                    k = column[name]
                    total[:, k] += _expected(lattice, part["word"].tolist(), part["n"].to_numpy(float), probs[:, k])
            piece, language = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": language, "uses": total[piece, language]})

        uses = (
            words.mapInPandas(step, "piece int, language int, uses double")
            .groupBy("piece", "language")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()  # at most pieces times languages
        )
        total = np.full_like(probs, smoothing)
        total[uses["piece"], uses["language"]] += uses["uses"].round(6)
        probs = total / total.sum(0)
    seen = np.array([sizes[k] for k in names], float)
    return PieceModel(pieces, names, probs, np.log(seen / seen.sum()))


def _slices(batch: pd.Series) -> Iterator[list[list[str]]]:
    """The words of each text, in runs of texts with about ``SLICE_WORDS`` words in all."""
    texts, size = [], 0
    for text in batch:
        texts.append(letter_words(text))
        size += len(texts[-1])
        if size >= SLICE_WORDS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def identify(model: PieceModel, text: Column, spark) -> Column:
    """A struct ``(lang string, score double, log_prob double)`` per text.

    ``score`` is the posterior of the chosen language and ``log_prob`` the natural logarithm of
    the text's probability in it per word. Texts that are null or have no letter are ``und`` with
    score 0, as is everything under a model without languages. Ties go to the first name.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, log_prob double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        lattice, probs = Lattice(model.pieces), _with_none(model.probs)
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)))
        for batch in batches:
            out = []
            for texts in _slices(batch):
                if len(known) > CACHE_WORDS:
                    known, table = {}, table[:0]
                new = list({w for words in texts for w in words} - known.keys())
                if new and model.languages:
                    logs = np.empty((len(new), len(model.languages)))
                    for part, ids in lattice.by_length(new):
                        logs[part] = np.log(lattice.forward(lattice.arcs(ids, probs))[:, -1])
                    known.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.vstack([table, logs])
                for words in texts:
                    if not words or not model.languages:
                        out.append(("und", 0.0, None))
                        continue
                    logs = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                    joint = logs + model.log_prior
                    best = int(joint.argmax())
                    score = 1.0 / np.exp(joint - joint[best]).sum()
                    out.append((model.languages[best], float(score), float(logs[best] / len(words))))
            yield pd.DataFrame(out, columns=["lang", "score", "log_prob"])

    return scored(text)


def predictions(model: PieceModel, docs: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """``docs`` with the prediction as one struct column ``names['into']`` (``lang_id`` unless given)."""
    return docs.withColumn(names.get("into", "lang_id"), identify(model, F.col(text), docs.sparkSession))
