"""Importance resampling against plain Python on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter

from lanewise.llm import importance

TEXTS = [
    "The cat, the CAT sat on a mat-rug " * 3, None, "", "...", "one", "Größe é É 数字 12a " * 6, "a" * 300_000 + " end " * 25,
    "the cat sat on the mat and the dog sat on the cat again and again until the rug was gone for good",
]


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def slow(docs, target):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = count(text for _, text in docs), count(target)
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10000)]
    out = []
    for name, text in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(found), weight, score, len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * 25 // 100], 1)}
    return sorted(((r[0], r[1], r[2], r[3], rank.get(id(r))) for r in out), key=repr)


def test_resample_equals_plain_python(spark):
    docs = [(i if i % 9 else None, TEXTS[i % len(TEXTS)] if i % 3 else f"{i} " + TEXTS[-1]) for i in range(90)]
    docs += [(1, TEXTS[-1]), (1, TEXTS[-1])]
    target = ["the cat sat", None, "", "the mat and the dog"]
    table = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table, bench)
    shown = sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert shown == slow(docs, target)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1))
    assert set(importance.drawn(table, got).columns) == {"doc_id", "text", "score"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 30)] * 4, "doc_id long, text string")
    nothing = docs.limit(0)
    assert importance.resample(nothing, docs).count() == 0
    assert [r["rank"] for r in importance.resample(docs, nothing.select("text")).where("rank IS NOT NULL").collect()] == [1]


def test_slices_do_not_change_the_features():
    text = ("Ab c1-d é " * 50 + "x" * 40).encode()
    whole = Counter(h for hashes in importance.feature_hashes(text, 3) for h in hashes)
    for size in (1, 5, 64):
        assert Counter(h for hashes in importance.feature_hashes(text, 3, size) for h in hashes) == whole
    words, _ = features(text.decode())
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert whole == Counter(zlib.crc32(r.encode()) for r in runs)
