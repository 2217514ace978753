"""A Katz back-off model: Good-Turing discounts, exactly normalised back-off weights.

    P(w | h) = s(h) d(c) c(h, w) / c(h) when c(h, w) > 0, d(c) = 1 above ``K``
             = alpha(h) P(w | h')       otherwise; h' is h without its first word
    P(w)     = d1(c) c(w) / N           when c(w) > 0
             = p0 / unseen              otherwise

``alpha(h)`` makes the probabilities after h add up to one: the mass left by the discounts over
the mass after h' of the words not seen after h. Where the discounts leave nothing, half a count is
set aside and ``s(h)``, one elsewhere, scales the seen words down to what remains. ``unseen`` is the
number of words that occur in the scored texts only, one at least, so the unigrams add up to one as
well. A history never seen in training answers like h'. The first word of a text has a history of
one word, its start; every later one has two words in a model of order 3.

A row per occurrence would be several times the size of the texts, so every table here moves as
packed arrays. A chunk is a few thousand documents with a vocabulary of its own, written once. It
asks the count tables, partitioned by word and by history, for its distinct words, pairs and triples,
and gets an array of answers per partition. Words are hashes until they are counted, then numbers:
frequent words have small ones, so that n-grams pack well. What a partition of pairs holds of a
history is bounded: histories frequent in training are split over several partitions by the next
word, and only sums over their words meet again. Of any other history one partition knows all words,
and its sums come with the answer.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import mix64, word_hashes, words_of
from lanewise.session import discard, stored

K = 5
CHUNK_TOKENS = 600_000
PART_TOKENS = 2_000_000
SPLIT_HISTORY = 200_000
START = np.uint64(0)  # the number of the start as a history; words have higher ones
END = np.uint64(2)  # never the hash of a word: those are replaced
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HEAD = struct.Struct("<BQ")
TOLD = np.uint8(1 << 7)  # beside the bits of ``low``: sums of the history are in the answer


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane so that small numbers compress; planes of zeros are left out."""
    values = np.ascontiguousarray(values)
    width = values.itemsize
    if values.dtype.kind == "u":
        width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T
    head = _HEAD.pack(width, len(values))
    return head + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True) if planes.size else head


def unpack(data: bytes, kind) -> np.ndarray:
    width, count = _HEAD.unpack_from(data)
    out = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
    if width and count:
        raw = pa.Codec("zstd").decompress(memoryview(data)[_HEAD.size :], width * count, asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, count).T
    return out.reshape(-1).view(kind)


def _joined(packed, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in packed)])


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    place, names = pd.factorize(values)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return names[order], rank[place]


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct code, by rising code, and the place of every code among them."""
    count = len(codes)
    bits = count.bit_length()
    if int(codes.max(initial=0)).bit_length() + bits <= 64:  # sorting numbers is quicker than sorting places
        both = np.sort((codes.astype(np.uint64) << np.uint64(bits)) | np.arange(count, dtype=np.uint64))
        at, codes = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        at = np.argsort(codes, kind="stable")
        codes = codes[at]
    new = np.ones(count, bool)
    new[1:] = codes[1:] != codes[:-1]
    place = np.empty(count, np.int64)
    place[at] = np.cumsum(new) - 1
    return at[new], place


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Positions by partition, otherwise in order."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's discount ratios d(0..K); d(c) is 1 where the estimate is undefined or not in (0, 1]."""
    n = np.array([0] + [counts_of_counts.get(r, 0) for r in range(1, K + 2)], float)
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        if n[r] and common < 1:
            ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            d[r] = ratio if 0 < ratio <= 1 else 1.0
    return d


class Unigrams:
    """Discounted unigram probabilities as a function of the count."""

    def __init__(self, total: int, counts_of_counts: dict[int, int], distinct: int, unseen: int):
        self.total, self.d = total, discounts(counts_of_counts)
        mass = sum(n * r * (1 - self.d[r]) for r, n in counts_of_counts.items() if r <= K) / total if total else 1.0
        if total and mass <= 0:  # nothing left by Good-Turing: one count is set aside
            self.scale, mass = total / (total + 1), 1 / (total + 1)
        else:
            self.scale = 1.0
        self.new = mass / max(1, unseen)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(float)
        seen = self.scale * c * self.d[np.minimum(counts, K).astype(np.int64)] / max(1, self.total)
        seen = np.where(counts > K, self.scale * c / max(1, self.total), seen)
        return np.where(counts > 0, seen, self.new)


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents with local vocabularies."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, out, texts, size = [], [], [], 0

        def chunk() -> pd.DataFrame:
            lengths = np.array([len(t) for t in texts], np.uint32)
            vocab, tokens = _distinct(np.concatenate(texts))
            train = np.repeat([not h for _, h in ids], lengths)
            counts = np.bincount(tokens[train], minlength=len(vocab)).astype(np.uint32)
            row = {
                "chunk": uuid.uuid4().hex, "doc_ids": pack(np.array([i or 0 for i, _ in ids], np.int64)),
                "null_ids": pack(np.array([i is None for i, _ in ids], np.uint8)), "held": pack(np.array([h for _, h in ids], np.uint8)),
                "lengths": pack(lengths), "vocab": pack_sorted(vocab), "counts": pack(counts),
                "tokens": pack(tokens.astype(np.uint32)), "size": int(lengths.sum()), "train_docs": sum(not h for _, h in ids),
            }
            return pd.DataFrame([row])

        for batch in batches:
            for doc_id, is_held, text in zip(batch["doc_id"], batch["held"], batch["text"]):
                h = word_hashes(words_of(text))
                h[h <= END] += np.uint64(3)
                texts.append(np.append(h, END))
                ids.append((None if pd.isna(doc_id) else int(doc_id), bool(is_held)))
                size += len(h) + 1
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    ids, texts, size = [], [], 0
        if texts:
            yield chunk()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held", "text").mapInPandas(
        build,
        "chunk string, doc_ids binary, null_ids binary, held binary, lengths binary, vocab binary, counts binary, tokens binary, size long, train_docs long",
    )


def _count_words(chunks: DataFrame, parts: int) -> DataFrame:
    """Answers (chunk, part, counts, numbers), and per part the statistics of its words."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, vocab, counts in zip(batch["chunk"], batch["vocab"], batch["counts"]):
                vocab, counts = unpack_sorted(vocab), unpack(counts, np.uint32)
                part = (mix64(vocab) % np.uint64(parts)).astype(np.int64)
                order = _by_part(part, parts)
                each = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
                rows = [(part[mine[0]], name, pack_sorted(vocab[mine]), pack(counts[mine])) for mine in each]
                yield pd.DataFrame(rows, columns=["part", "chunk", "words", "counts"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        words = [unpack_sorted(w) for w in group["words"]]
        keys, place = _distinct(np.concatenate(words))
        total = np.bincount(place, _joined(group["counts"], np.uint32), len(keys)).astype(np.uint64)
        # numbers from 1: by falling count in a partition, whose numbers lie ``parts`` apart
        number = np.empty(len(keys), np.uint64)
        number[np.argsort(~total, kind="stable")] = np.arange(len(keys), dtype=np.uint64) * np.uint64(parts)
        number += np.uint64(int(group["part"].iloc[0]) + 1)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        out = pd.DataFrame({"part": group["part"], "chunk": group["chunk"], "counts": [pack(x) for x in np.split(total[place], cuts)]})
        out["numbers"] = [pack(x) for x in np.split(number[place], cuts)]
        few = np.bincount(np.minimum(total, K + 2).astype(np.int64), minlength=K + 3)
        out["few"] = [[int(x) for x in few] if k == 0 else None for k in range(len(out))]
        out["total"] = [int(total.sum()) if k == 0 else 0 for k in range(len(out))]
        return out

    asked = chunks.select("chunk", "vocab", "counts").mapInPandas(ask, "part int, chunk string, words binary, counts binary")
    return stored(
        asked.groupBy("part").applyInPandas(answer, "part int, chunk string, counts binary, numbers binary, few array<long>, total long"),
        "word-counts",
    )


def _numbered(chunks: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """Chunks whose vocabularies are the numbers of their words, rising, with their counts."""
    answers = words.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "counts", "numbers"))).alias("answers"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                answers, tokens = row.pop("answers"), unpack(row["tokens"], np.uint32)
                order = _by_part((mix64(unpack_sorted(row.pop("vocab"))) % np.uint64(parts)).astype(np.int64), parts)
                numbers, counts = (_joined([a[x] for a in answers], np.uint64) for x in ("numbers", "counts"))
                rising = np.argsort(numbers)
                rank = np.empty(len(order), np.uint32)
                rank[order[rising]] = np.arange(len(order), dtype=np.uint32)
                row |= {"numbers": pack_sorted(numbers[rising]), "counts": pack(counts[rising]), "tokens": pack(rank[tokens])}
                yield pd.DataFrame([row])

    return chunks.drop("counts", "size", "train_docs").join(answers, "chunk").mapInPandas(
        number, "chunk string, doc_ids binary, null_ids binary, held binary, lengths binary, numbers binary, counts binary, tokens binary"
    )


def _pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A history of two words as one number."""
    return mix64(u * _ODD + mix64(v))


class Grams:
    """Distinct n-grams of a chunk in the order in which they are asked for and answered.

    They come by history and word. A partition is that of the history, and of the word too for
    histories that are frequent. ``of`` restricts what is asked for.
    """

    def __init__(self, h: np.ndarray, words: np.ndarray, h_keys: np.ndarray, h_counts: np.ndarray, parts: int, limit: int, of=None):
        split = np.maximum(1, (h_counts.astype(np.int64) + limit - 1) // limit).astype(np.uint64)
        part = (mix64(h_keys * _ODD) % np.uint64(parts)).astype(np.int64)[h]
        often = np.flatnonzero((split > 1)[h])
        salt = mix64(words[often]) % split[h[often]]
        part[often] = (mix64(h_keys[h[often]] * _ODD + salt) % np.uint64(parts)).astype(np.int64)
        self.order = _by_part(part, parts) if of is None else of[_by_part(part[of], parts)]
        self.h, self.words, self.part = h[self.order], words[self.order], part[self.order]
        other = np.ones(len(self.order), bool)
        other[1:] = (self.h[1:] != self.h[:-1]) | (self.part[1:] != self.part[:-1])
        self.starts = np.flatnonzero(other)  # a run has one history and one partition
        self.history = self.h[self.starts]
        self.often = split[self.history] > 1

    def requests(self, name: str, u: np.ndarray, by_word: dict, by_run: dict) -> pd.DataFrame:
        """A row per partition: runs, words, and what else goes with each word or run.

        ``u`` is the first word of each run's history; it rises within a partition.
        """
        begin = np.flatnonzero(np.diff(self.part, prepend=-1))
        first = np.searchsorted(self.starts, begin)
        words, u_step = np.diff(self.words, prepend=np.uint64(0)), np.diff(u, prepend=np.uint64(0))
        words[self.starts], u_step[first] = self.words[self.starts], u[first]
        by_word = {"words": words} | by_word
        runs = np.diff(np.append(self.starts, len(self.h))).astype(np.uint32)
        by_run = {"u": u_step, "runs": runs, "often": self.often.astype(np.uint8)} | by_run
        out = {"part": self.part[begin], "chunk": [name] * len(begin)}
        for x, values in by_word.items():
            out[x] = [pack(v) for v in np.split(values, begin[1:])] if len(begin) else []
        for x, values in by_run.items():
            out[x] = [pack(v) for v in np.split(values, first[1:])] if len(begin) else []
        return pd.DataFrame(out)


def _answer(group: pd.DataFrame, shorter) -> pd.DataFrame:
    """Counts of the asked n-grams, and sums over the words seen after the histories in doubt.

    ``shorter`` gives the probability of words after the history without its first word, by the
    places of the words and of their runs.
    """
    runs = [unpack(x, np.uint32).astype(np.int64) for x in group["runs"]]
    run_cuts, cuts = np.cumsum([len(x) for x in runs]), np.cumsum([x.sum() for x in runs])
    run = np.concatenate(runs)
    starts = np.cumsum(run) - run
    steps = _joined(group["words"], np.uint64)
    words = np.cumsum(steps, dtype=np.uint64)
    words -= np.repeat(words[starts] - steps[starts], run)
    h = np.concatenate([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in group["u"]])
    if "v" in group:
        h = _pair_key(h, _joined(group["v"], np.uint64))
    place, grams = pd.factorize(np.repeat(h * _ODD, run) + words)
    total = np.bincount(place, _joined(group["counts"], np.uint32), len(grams)).astype(np.uint64)
    one = np.empty(len(grams), np.int64)  # a place of each n-gram
    one[place] = np.arange(len(place))
    one_run = np.searchsorted(starts, one, "right") - 1
    few = np.bincount(np.minimum(total, K + 2).astype(np.int64), minlength=K + 3)
    history, names = pd.factorize(h)
    of = history[one_run]
    sums = [np.bincount(of, total == r, len(names)) for r in range(1, K + 1)]
    sums.append(np.bincount(of, np.where(total > K, total, 0), len(names)))
    mass = np.bincount(of, np.where(total > 0, shorter(group, one, one_run), 0.0), len(names))
    # which of the counts 1..K occur here after each history
    low = sum((sums[r] > 0).astype(np.uint8) << r for r in range(K))
    sums = np.stack(sums)
    often = _joined(group["often"], np.uint8) > 0
    # a history that is not split has all its words here: sums where the chunk has a word that training has not
    told = np.logical_or.reduceat((total == 0)[place], starts) & ~often & (sums.sum(0) > 0)[history]
    flags = low[history] | np.where(told, TOLD, np.uint8(0))
    out = pd.DataFrame({"chunk": group["chunk"], "part": group["part"], "answer": [pack(x) for x in np.split(total[place], cuts[:-1])]})
    out["few"] = [[int(x) for x in few] if k == 0 else None for k in range(len(out))]
    out["low"] = [pack(x) for x in np.split(flags, run_cuts[:-1])]
    wanted = [x[y] for x, y in zip(np.split(history, run_cuts[:-1]), np.split(told, run_cuts[:-1]))]
    out["used"] = [pack(sums[:, x].astype(np.uint64).reshape(-1)) for x in wanted]
    out["mass"] = [pack(mass[x]) for x in wanted]
    out["doubt"] = [x[y].tobytes() for x, y in zip(np.split(h, run_cuts[:-1]), np.split(often, run_cuts[:-1]))]
    split = np.unique(history[often])
    out["names"] = [pack(names[split]) if k == 0 else None for k in range(len(out))]
    out["sums"] = [np.vstack([sums, mass])[:, split].tobytes() if k == 0 else None for k in range(len(out))]
    return out


_ASK = "part int, chunk string, words binary, counts binary, w_counts binary, u binary, runs binary, often binary"
_ANSWER = "chunk string, part int, answer binary, few array<long>, low binary, used binary, mass binary, doubt binary, names binary, sums binary"


def _collected(grams: DataFrame, d: np.ndarray, level: str) -> tuple[DataFrame, DataFrame]:
    """Per chunk the answers of all parts, and the sums of its histories that are split."""
    told = F.struct("part", "answer", "low", "used", "mass")
    answers = grams.groupBy("chunk").agg(F.sort_array(F.collect_list(told)).alias(f"{level}_answers"))
    weights = _doubts(grams).join(_backoff(grams, d), "history").groupBy("chunk")
    weights = weights.agg(F.sort_array(F.collect_list(F.struct("history", "used", "mass"))).alias("w"))
    # arrays of numbers: Python would make an object of each struct
    return answers, weights.select("chunk", *[F.col(f"w.{x}").alias(f"{level}_{x}") for x in ("history", "used", "mass")])


class Level:
    """Counts and probabilities of a chunk's n-grams of one length."""

    def __init__(self, row, level: str, grams: Grams, h: np.ndarray, h_keys: np.ndarray, h_counts: np.ndarray, d: np.ndarray):
        self.h, self.h_counts, self.d = h, h_counts, d
        answers = getattr(row, f"{level}_answers")
        answers = () if answers is None else answers
        self.c = np.zeros(len(h), np.uint64)
        self.c[grams.order] = _joined([a["answer"] for a in answers], np.uint64)
        flags, low = _joined([a["low"] for a in answers], np.uint8), np.zeros(len(h_keys), np.uint8)
        np.bitwise_or.at(low, grams.history, flags & ~TOLD)
        discounted = np.uint8(sum(1 << (r - 1) for r in range(1, K + 1) if d[r] < 1))
        self.full = ((low & discounted) == 0) & (h_counts > 0)
        self.log_alpha = np.zeros(len(h_keys))
        weight = _weights(d)
        used = [weight @ unpack(a["used"], np.uint64).reshape(K + 1, -1) for a in answers]
        self.tell(grams.history[flags >= TOLD], np.concatenate([np.zeros(0), *used]), _joined([a["mass"] for a in answers], np.float64))
        names = getattr(row, f"{level}_history")
        if names is not None and len(names):
            names = np.asarray(names, np.int64)
            at = np.searchsorted(names, h_keys.view(np.int64)).clip(max=len(names) - 1)
            told = np.flatnonzero((names[at] == h_keys.view(np.int64)) & (h_counts > 0))
            self.tell(told, *(np.asarray(getattr(row, f"{level}_{x}"))[at[told]] for x in ("used", "mass")))

    def tell(self, told: np.ndarray, used: np.ndarray, mass: np.ndarray) -> None:
        """Back-off weights of histories from the sums over the words seen after them."""
        count = self.h_counts[told].astype(float)
        left = 1 - used / count
        self.full[told] = left <= 1e-12
        left = np.where(self.full[told], set_aside(count), left)
        self.log_alpha[told] = np.log10(left / np.maximum(1 - mass, 1e-300))

    def log(self, shorter: np.ndarray) -> np.ndarray:
        """log10 of the probabilities, given those after the shorter history."""
        seen = self.c > 0
        out = shorter + self.log_alpha[self.h]
        out[seen] = np.log10(seen_probability(self.c[seen], self.h_counts[self.h[seen]], self.full[self.h[seen]], self.d))
        return out


def _weights(d: np.ndarray) -> np.ndarray:
    """What the sums of a history add to its discounted count: words of count 1..K, and counts above."""
    return np.append(d[1:] * np.arange(1, K + 1), 1.0)


def set_aside(count: np.ndarray) -> np.ndarray:
    """Mass for unseen words after a history whose discounts are all one: half a count."""
    return 0.5 / (count + 1)


def seen_probability(c: np.ndarray, h_count: np.ndarray, full: np.ndarray, d: np.ndarray) -> np.ndarray:
    ratio = np.where(c > K, 1.0, d[np.minimum(c, K).astype(np.int64)])
    count = np.maximum(h_count, 1).astype(float)
    return ratio * c / count * np.where(full, 1 - set_aside(count), 1.0)


class Chunk:
    """A chunk with the counts of its words and, once they are answered, of its pairs and triples.

    Its words have places from 1; 0 stands for the start as a history.
    """

    def __init__(self, row, parts: int, start_count: int, limit: int):
        self.row, self.parts, self.limit = row, parts, limit
        self.lengths, self.tokens = unpack(row.lengths, np.uint32).astype(np.int64), unpack(row.tokens, np.uint32).astype(np.int64) + 1
        self.held = unpack(row.held, np.uint8) > 0
        self.train = np.repeat(~self.held, self.lengths)
        self.keys = np.append(START, unpack_sorted(row.numbers))
        self.every = np.append(np.uint64(start_count), unpack(row.counts, np.uint64))
        self.start = np.cumsum(self.lengths) - self.lengths
        history = np.zeros(len(self.tokens), np.int64)
        history[1:] = self.tokens[:-1]
        history[self.start] = 0
        one, self.place = _ranked(history * len(self.keys) + self.tokens)
        self.h, self.w = history[one], self.tokens[one]
        self.pair_grams = Grams(self.h, self.keys[self.w], self.keys, self.every, parts, limit)

    def pairs(self, d: np.ndarray) -> Level:
        return Level(self.row, "pair", self.pair_grams, self.h, self.keys, self.every, d)

    def ask_pairs(self) -> pd.DataFrame:
        g = self.pair_grams
        counts = np.bincount(self.place[self.train], minlength=len(self.h)).astype(np.uint32)
        by_word = {"counts": counts[g.order], "w_counts": self.every[self.w[g.order]]}
        return g.requests(self.row.chunk, self.keys[g.history], by_word, {})

    def triples(self, pairs: Level) -> None:
        """Lays out the triples; only those whose first two words are a history of training need an answer."""
        self.pair_keys = _pair_key(self.keys[self.h], self.keys[self.w])
        later = np.ones(len(self.tokens), bool)
        later[self.start] = False
        self.at = np.flatnonzero(later)
        one, self.triple = _ranked(self.place[self.at - 1] * len(self.keys) + self.tokens[self.at])
        self.h3, self.lower = self.place[self.at[one] - 1], self.place[self.at[one]]
        words = self.keys[self.tokens[self.at[one]]]
        asked = np.flatnonzero(pairs.c[self.h3] > 0)
        self.triple_grams = Grams(self.h3, words, self.pair_keys, pairs.c, self.parts, self.limit, asked)

    def ask_triples(self, d: np.ndarray) -> pd.DataFrame:
        two = self.pairs(d)
        self.triples(two)
        g = self.triple_grams
        counts = np.bincount(self.triple[self.train[self.at]], minlength=len(self.h3)).astype(np.uint32)
        u, v = self.h[g.history], self.w[g.history]
        # c(v, w) of each triple u v w, and of each history u v the count of v
        by_word = {"counts": counts[g.order], "w_counts": two.c[self.lower[g.order]]}
        by_run = {"v": self.keys[v], "v_counts": self.every[v], "v_full": two.full[v].astype(np.uint8)}
        return g.requests(self.row.chunk, self.keys[u], by_word, by_run)

    def log_tokens(self, uni: Unigrams, d: np.ndarray, d3: np.ndarray | None) -> np.ndarray:
        """log10 of the probability of every token."""
        two = self.pairs(d)
        log_pair = two.log(np.log10(uni(self.every[self.w])))
        out = log_pair[self.place]
        if d3 is not None:
            self.triples(two)
            three = Level(self.row, "triple", self.triple_grams, self.h3, self.pair_keys, two.c, d3)
            out[self.at] = three.log(log_pair[self.lower])[self.triple]
        return out


def score_documents(
    docs: DataFrame,
    held: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    parts: int | None = None,
    split_history: int = SPLIT_HISTORY,
    order: int = 2,
) -> DataFrame:
    """Scores of all documents under a model learned from those that are not ``held``.

    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-0.1
    unigrams) and ``score`` (Katz n-grams of ``order`` words, 2 or 3), log10 of the whole text
    including its end. Words are compared with A-Z lower-cased. Null and empty texts are the end
    alone; null ids and repeated rows are carried through and learned from like any other; a corpus
    without training documents scores by the new-word mass alone. Other columns are ignored, and no
    rows give no rows.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order} is not 2 or 3")
    rows = docs.withColumn("__held", held).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col("__held").alias("held")
    )
    chunks = stored(_chunks(rows), "chunks")
    size, train_docs = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    parts = parts or max(8, -(-size // PART_TOKENS))
    words = _count_words(chunks, parts)
    total = words.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    few = _few(words)
    distinct = sum(n for r, n in few.items() if r > 0)
    uni = Unigrams(total, few, distinct, few.get(0, 0))
    context = docs.sparkSession.sparkContext
    told = context.broadcast(uni)
    full = stored(_numbered(chunks, words, parts), "counted-chunks")
    discard(chunks, words)

    def ask_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield Chunk(row, parts, train_docs, split_history).ask_pairs()

    def word_probability(group: pd.DataFrame, word: np.ndarray, run: np.ndarray) -> np.ndarray:
        return told.value(_joined(group["w_counts"], np.uint64)[word])

    asked = full.mapInPandas(ask_pairs, _ASK)
    pairs = stored(asked.groupBy("part").applyInPandas(lambda g: _answer(g, word_probability), _ANSWER), "pair-counts")
    d = discounts(_few(pairs))
    answers, wanted = _collected(pairs, d, "pair")
    ready = full.join(answers, "chunk").join(wanted, "chunk", "left")
    d3 = None
    if order == 3:
        ready = stored(ready, "paired-chunks")
        discard(full, pairs)

        def ask_triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield Chunk(row, parts, train_docs, split_history).ask_triples(d)

        def pair_probability(group: pd.DataFrame, word: np.ndarray, run: np.ndarray) -> np.ndarray:
            count, whole = _joined(group["v_counts"], np.uint64)[run], _joined(group["v_full"], np.uint8)[run] > 0
            return seen_probability(_joined(group["w_counts"], np.uint64)[word], count, whole, d)

        asked = ready.mapInPandas(ask_triples, f"{_ASK}, v binary, v_counts binary, v_full binary")
        triples = stored(asked.groupBy("part").applyInPandas(lambda g: _answer(g, pair_probability), _ANSWER), "triple-counts")
        d3 = discounts(_few(triples))
        answers, wanted = _collected(triples, d3, "triple")
        ready = ready.join(answers, "chunk", "left").join(wanted, "chunk", "left")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def evaluate_one(row) -> pd.DataFrame:
        x = Chunk(row, parts, train_docs, split_history)
        log_token = x.log_tokens(told.value, d, d3)
        base = np.log10((x.every + 0.1) / (total + 0.1 * (distinct + 1)))
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(unpack(row.doc_ids, np.int64), unpack(row.null_ids, np.uint8) > 0),
                "held_out": x.held,
                "n_tokens": x.lengths,
                "n_known": np.add.reduceat((x.every > 0)[x.tokens].astype(np.int64), x.start),
                "train_tokens": total,
                "base_score": np.add.reduceat(base[x.tokens], x.start),
                "score": np.add.reduceat(log_token, x.start),
            }
        )

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield evaluate_one(row)

    return ready.mapInPandas(evaluate, out)


def _few(table: DataFrame) -> dict[int, int]:
    """How many keys have each count up to K+1; K+2 stands for all higher ones."""
    rows = table.where("few IS NOT NULL").select(F.posexplode("few").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    return {x["r"]: x["n"] for x in rows}


def _doubts(pairs: DataFrame) -> DataFrame:
    """(chunk, history) of the split histories that a chunk has."""

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, names in zip(batch["chunk"], batch["doubt"]):
                yield pd.DataFrame({"history": np.frombuffer(names, np.int64)}).assign(chunk=chunk)[["chunk", "history"]]

    return pairs.where(F.octet_length("doubt") > 0).select("chunk", "doubt").mapInPandas(unfold, "chunk string, history long")


def _backoff(pairs: DataFrame, d: np.ndarray) -> DataFrame:
    """(history, used, mass): discounted counts and mass after h' of the words seen after a split history.

    A history's partitions each hold other words, so their sums add up.
    """

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = _weights(d)
        for batch in batches:
            for names, sums in zip(batch["names"], batch["sums"]):
                names, table = unpack(names, np.int64), np.frombuffer(sums).reshape(K + 2, -1)
                yield pd.DataFrame({"history": names, "used": weight @ table[:-1], "mass": table[-1]})

    parts = pairs.where("names IS NOT NULL").select("names", "sums")
    parts = parts.mapInPandas(unfold, "history long, used double, mass double")
    return parts.groupBy("history").agg(F.sum("used").alias("used"), F.sum("mass").alias("mass"))
