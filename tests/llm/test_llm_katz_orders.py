"""Katz scores of both orders against a dictionary model that adds up to one after every history."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lanewise.llm import katz
from lanewise.llm.common import crc_bucket

K = katz.K


class Plain:
    def __init__(self, rows, order):
        self.order = order
        self.count = [None] + [Counter() for _ in range(order)]
        words = set()
        for text, held in rows:
            words.update(self.tokens(text))
            for h, w in self.grams(text) if not held else ():
                for n in range(len(h) + 1):
                    self.count[n + 1][h[len(h) - n :] + (w,)] += 1
        self.n = sum(self.count[1].values())
        self.words = words | {"a word of no text"} if words <= {w for (w,) in self.count[1]} else words
        self.unseen = len(self.words) - len(self.count[1])
        self.d = [None] + [katz.discounts(Counter(c.values())) for c in self.count[1:]]
        self.after = defaultdict(dict)
        for c in self.count[2:]:
            for g, k in c.items():
                self.after[g[:-1]][g[-1]] = k
        self.mass = sum(c * (1 - self.d[1][c]) for c in self.count[1].values() if c <= K) / self.n
        self.scale = 1.0
        if self.mass <= 0:
            self.scale, self.mass = self.n / (self.n + 1), 1 / (self.n + 1)

    @staticmethod
    def tokens(text):
        return [w.lower() for w in (text or "").split()] + ["</s>"]

    def grams(self, text):
        tokens = ["<s>", *self.tokens(text)]
        return [(tuple(tokens[max(0, i - self.order + 1) : i]), tokens[i]) for i in range(1, len(tokens))]

    def kept(self, c, n):
        return c * (self.d[n][c] if c <= K else 1)

    def p(self, h, w):
        if not h:
            c = self.count[1][w,]
            return self.scale * self.kept(c, 1) / self.n if c else self.mass / self.unseen
        seen = self.after.get(h)
        if not seen:
            return self.p(h[1:], w)
        total, n = sum(seen.values()), len(h) + 1
        left = 1 - sum(self.kept(c, n) for c in seen.values()) / total
        scale = 1.0
        if left <= 1e-12:
            left = 0.5 / (total + 1)
            scale = 1 - left
        if w in seen:
            return scale * self.kept(seen[w], n) / total
        return left / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def score(self, text):
        return sum(math.log10(self.p(h, w)) for h, w in self.grams(text))


def corpus():
    """Random texts, and a template copied often enough that no discount applies inside it."""
    r = random.Random(5)
    vocab = ["w%d" % int(r.paretovariate(0.9)) for _ in range(200)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 40))) for _ in range(150)]
    return texts + ["all rights reserved by the owner"] * 40 + ["rights w1 w2", "all rights", "reserved by w1", "the owner w3"] * 3


def is_held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("order", [2, 3])
def test_every_history_adds_up_to_one(order):
    plain = Plain([(t, is_held(i)) for i, t in enumerate(corpus())], order)
    full = 0
    for h, seen in plain.after.items():
        full += 1 - sum(plain.kept(c, len(h) + 1) for c in seen.values()) / sum(seen.values()) <= 1e-12
        if len(h) < order and (full < 20 or len(h) == 1):
            assert math.isclose(sum(plain.p(h, w) for w in plain.words), 1, rel_tol=1e-9)
    assert full


@pytest.mark.parametrize("order,split", [(2, 200_000), (2, 20), (3, 200_000), (3, 20)])
def test_scores_equal_normalised_model(spark, monkeypatch, order, split):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 1000)
    texts = corpus()
    plain = Plain([(t, is_held(i)) for i, t in enumerate(texts)], order)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = katz.score_documents(table, crc_bucket("doc_id", 10) == 0, parts=5, split_history=split, order=order).collect()
    assert len(got) == len(texts)
    for g in got:
        assert math.isclose(g["score"], plain.score(texts[g["doc_id"]]), rel_tol=1e-9), texts[g["doc_id"]]
