"""Importance resampling towards a target text: hashed n-gram counts, then a Gumbel draw.

Words come from bytes alone: one 256-byte table lower-cases A-Z and blanks every other ASCII
character that is no letter or digit, and ``bytes.split`` yields the words. The crc32 of an n-gram
is the crc32 of its last word, seeded with that of the n-gram before it, so no n-gram is ever built.
Texts never move: one pass counts the features, a second one weighs the documents.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.session import stored

WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in WORD_BYTES else 32 for b in range(256))


def word_slices(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words, in lists from about ``size`` bytes each, so that a long text is not split at once."""
    blanked, at = text.translate(TABLE), 0
    while at < len(blanked):
        end = len(blanked) if at + size >= len(blanked) else blanked.find(b" ", at + size)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end


def feature_hashes(text: bytes, most: int = 2, size: int = 1 << 20) -> Iterator[list[int]]:
    """crc32 of all runs of 1 to ``most`` words joined by one space, in lists of bounded length."""
    before: list[int | None] = [None] * most  # of each length, the run that ended the slice before
    for words in word_slices(text, size):
        if not words:
            continue
        runs, tails = list(map(crc32, words)), [b" " + w for w in words]
        for k in range(most):
            yield runs
            last = runs[-1] if runs else before[k]
            if k + 1 < most:
                seeds = runs[:-1] if before[k] is None else [before[k], *runs[:-1]]
                runs = list(map(crc32, tails[len(tails) - len(seeds) :], seeds))
            before[k] = last


def feature_counts(texts: DataFrame, buckets: int = 10000, most: int = 2, text: str = "text") -> DataFrame:
    """``bucket``, ``n``: how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    for hashes in feature_hashes(value.as_py(), most):
                        seen.update([h % buckets for h in hashes])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["bucket", "n"]
        )

    encoded = texts.select(F.col(text).cast("binary").alias("text"))
    return encoded.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, smoothed by one.

    Both tables have at most ``buckets`` rows, whatever was counted.
    """
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (source, target))
    in_source, in_target = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [
        math.floor(1000 * math.log((t.get(b, 0) + 1) * in_source / ((s.get(b, 0) + 1) * in_target)))
        for b in range(buckets)
    ]


def noise(seed: int, doc_id: int | None) -> int:
    """A Gumbel variable in thousandths, floored: the same for an id in every run; null counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, gain: list[int], most: int = 2, seed: int = 7, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            out = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n = total = 0
                if value.is_valid:
                    for k, hashes in enumerate(feature_hashes(value.as_py(), most)):
                        n_words += 0 if k % most else len(hashes)
                        n += len(hashes)
                        total += sum([gain[h % buckets] for h in hashes])
                weight = total // n if n else 0
                out.append((name, n_words, n, weight, weight + noise(seed, name)))
            arrays = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(arrays, columns)

    encoded = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return encoded.mapInArrow(score, ", ".join(f"{c} long" for c in columns))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """The rows with ``rank``: 1, 2, 3 ... over the ``percent`` % of eligible rows that score highest.

    Ties go to the smaller ``doc_id``, nulls last. Scores are whole numbers, so there are few (a
    logarithm in thousandths), and rows are numbered within one score each, after a running count
    over the scores. The noise spreads rows over scores: none holds more than 4 in 10,000 of them,
    whatever their texts, unless ids repeat.
    """
    rivals = scored.where(eligible)
    drawn = rivals.count() * percent // 100
    per_score = rivals.groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))
    starts = per_score.select("score", (F.sum("n").over(down) - F.col("n")).alias("above")).where(F.col("above") < drawn)
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    place = F.row_number().over(Window.partitionBy("score").orderBy(*order))
    best = rivals.join(starts, "score").select(*scored.columns, (F.col("above") + place).alias("rank"))
    rest = scored.where(~F.coalesce(eligible, F.lit(False))).select("*", F.lit(None).cast("long").alias("rank"))
    below = rivals.join(starts, "score", "left_anti").select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    kept = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return best.select(*scored.columns, kept).union(below).union(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    buckets: int = 10000,
    most: int = 2,
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every row.

    Features are the runs of 1 to ``most`` words, hashed into ``buckets``; a document's weight is the
    floored mean gain of its features (0 without any), its score the weight plus Gumbel noise, which
    makes the best ``percent`` % a sample without replacement by weight. Only rows of ``least_words``
    words or more are drawn; the others have a null rank. Words are compared with A-Z lower-cased.
    Null and empty texts have no feature; repeated rows count each, with equal scores and ranks
    of their own; null ids share one noise and come last among ties. An empty target leaves the
    gains to the source alone. Empty tables give no rows. Other columns are ignored.
    """
    source = feature_counts(docs, buckets, most, text)
    gain = gains(source, feature_counts(target, buckets, most), buckets)
    scored = stored(weigh(docs, gain, most, seed, doc_id, text), "scores")
    return ranked(scored, F.col("n_words") >= least_words, percent)


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents that were drawn, with their own columns; rows without id are not looked up."""
    ids = ranks.where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
