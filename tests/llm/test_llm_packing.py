"""Packing: ids of the tokenizer, pieces without gaps, dominance against exact optima."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import packing

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def fewest(sizes, capacity):
    """Exact least number of sequences, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(20, 24))
def test_reduction_keeps_an_optimum(sizes, capacity):
    pool = packing.Lengths(Counter(sizes))
    fixed = packing.reduced(pool, capacity)
    rest = list(Counter(pool.counts).elements())
    assert Counter(rest) + Counter(w for found, k in fixed for w in found * k) == Counter(sizes)
    assert all(sum(found) <= capacity for found, _ in fixed)
    assert sum(k for _, k in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 50))
def test_best_fit_equals_one_by_one(counts, capacity):
    rooms = []
    for w in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - w)
        else:
            rooms.append(capacity - w)
    entries = packing.best_fit(counts, capacity)
    got = Counter()
    for contents, times in entries:
        got[capacity - sum(w * k for w, k in contents)] += times
    assert got == Counter(rooms)
    placed = Counter()
    for contents, times in entries:
        for w, k in contents:
            placed[w] += k * times
    assert placed == Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aB 1 .'s\n\t  é数🙂<|endoftext|> \x1c"), max_size=60))
def test_ids_equal_the_whole_text(text):
    tokens = packing._tokens(PATH)
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == want
    assert " ".join(packing.Tokens.slices(text, 3)) == text


def test_pieces_and_places(spark):
    r = random.Random(1)
    words = ["der", "lane", "wise,", "x1", "É", "größer", "\n", "the"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 10, 40, 100, 400]))) for _ in range(300)] + [None, "", "a" * 5000]
    rows = [(i if i % 50 else None, t, 7) for i, t in enumerate(texts)] + [(1, texts[1], 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    packed = packing.pack(table, PATH, capacity=64, with_ids=True)
    got = packed.collect()
    tokenizer = packing._tokens(PATH).tokenizer
    want = Counter()
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(g)[:5] for g in got) == want
    places = defaultdict(list)
    for g in got:
        places[g["sequence_id"]].append((g["offset"], g["length"], g["ids"]))
    for found in places.values():
        at = 0
        for offset, length, _ in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(g["length"] for g in got)
    assert len(places) <= -(-total // 64) + 2
    whole = {s["sequence_id"]: bytes(s["ids"]) for s in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(bytes(i) for _, _, i in sorted(v)) for k, v in places.items()}
    assert packing.pack(table.limit(0), PATH).count() == 0
