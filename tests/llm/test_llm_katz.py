"""Katz scores against a dictionary model."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lanewise.llm import katz
from lanewise.llm.common import crc_bucket

K = katz.K


class Plain:
    def __init__(self, rows):
        self.uni, self.bi, self.hist = Counter(), Counter(), Counter()
        words = set()
        for text, held in rows:
            tokens = self.tokens(text)
            words |= set(tokens)
            if not held:
                self.uni.update(tokens)
                pairs = list(zip(["<s>", *tokens], tokens))
                self.bi.update(pairs)
                self.hist.update(h for h, _ in pairs)
        self.n = sum(self.uni.values())
        self.unseen = len(words - self.uni.keys())
        self.du = katz.discounts(Counter(self.uni.values()))
        self.db = katz.discounts(Counter(self.bi.values()))
        self.after = defaultdict(dict)
        for (h, w), c in self.bi.items():
            self.after[h][w] = c
        self.mass = sum(c * (1 - self.du[c]) for c in self.uni.values() if c <= K) / self.n if self.n else 1.0
        self.scale = 1.0
        if self.n and self.mass <= 0:
            self.scale, self.mass = self.n / (self.n + 1), 1 / (self.n + 1)

    @staticmethod
    def tokens(text):
        return [w.lower().encode() for w in (text or "").split()] + ["</s>"]

    def p(self, w):
        c = self.uni[w]
        return self.scale * c * (self.du[c] if c <= K else 1) / self.n if c else self.mass / max(1, self.unseen)

    def pair(self, h, w):
        c = self.bi[h, w]
        if c:
            return c * (self.db[c] if c <= K else 1) / self.hist[h]
        if not self.hist[h]:
            return self.p(w)
        left = 1 - sum(c * (self.db[c] if c <= K else 1) for c in self.after[h].values()) / self.hist[h]
        if left <= 1e-12:
            left = 0.5 / (self.hist[h] + 1)
        return left / (1 - sum(map(self.p, self.after[h]))) * self.p(w)

    def score(self, text):
        tokens = self.tokens(text)
        return sum(math.log10(self.pair(h, w)) for h, w in zip(["<s>", *tokens], tokens))


def corpus(seed, count):
    r = random.Random(seed)
    vocab = ["w%d" % int(r.paretovariate(0.7)) for _ in range(400)]
    return [" ".join(r.choice(vocab).upper() if r.random() < 0.1 else r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("split", [200_000, 20])
def test_scores_equal_plain_model(spark, monkeypatch, split):
    texts = corpus(1, 300)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "w1 w2", "x", 1), (400, None, "x", 1), (401, "", "x", 1), (3, texts[3], "x", 1), (402, "w1 " * 30_000, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, chunk string, held int")
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, *_ in rows}
    if split < 1000:
        table, rows = table.where("doc_id <> 402 OR doc_id IS NULL"), [x for x in rows if x[0] != 402]
    plain = Plain([(t, held[i]) for i, t, *_ in rows])
    got = defaultdict(list)
    for g in katz.score_documents(table, crc_bucket("doc_id", 10) == 0, parts=5, split_history=split).collect():
        got[g["doc_id"]].append(g)
    distinct = len(plain.uni)
    for i, t, *_ in rows:
        for g in got[i]:
            tokens = plain.tokens(t)
            base = sum(math.log10((plain.uni[w] + 0.1) / (plain.n + 0.1 * (distinct + 1))) for w in tokens)
            assert (g["held_out"], g["n_tokens"], g["train_tokens"]) == (held[i], len(tokens), plain.n)
            assert g["n_known"] == sum(plain.uni[w] > 0 for w in tokens)
            assert math.isclose(g["base_score"], base, rel_tol=1e-9)
            assert math.isclose(g["score"], plain.score(t), rel_tol=1e-9), (i, t)
    assert sum(map(len, got.values())) == len(rows)


def test_model_is_normalised():
    rows = [(t, k % 10 == 0) for k, t in enumerate(corpus(2, 200))]
    plain = Plain(rows)
    words = {w for t, _ in rows for w in plain.tokens(t)}
    words |= set() if plain.unseen else {"a word of no text"}
    assert math.isclose(sum(map(plain.p, words)), 1, rel_tol=1e-9)
    for h in list(plain.after)[:20]:
        assert math.isclose(sum(plain.pair(h, w) for w in words), 1, rel_tol=1e-6) or 1 - sum(
            c * (plain.db[c] if c <= K else 1) for c in plain.after[h].values()
        ) / plain.hist[h] <= 1e-12


def test_edges(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert katz.score_documents(table.limit(0), crc_bucket("doc_id", 10) == 0).count() == 0
    from pyspark.sql import functions as F

    got = katz.score_documents(table, F.lit(True)).collect()
    assert len(got) == 2 and all(np.isfinite(g["score"]) and g["n_known"] == 0 and g["train_tokens"] == 0 for g in got)


def test_packing():
    for values in (np.zeros(0, np.uint64), np.array([3, 3, 2**63, 2**64 - 1], np.uint64)):
        assert (katz.unpack_sorted(katz.pack_sorted(values)) == values).all()
        assert (katz.unpack(katz.pack(values.astype(np.uint32)), np.uint32) == values.astype(np.uint32)).all()
