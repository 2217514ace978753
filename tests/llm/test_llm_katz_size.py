"""What moves between the steps of a Katz model: bytes of an asked triple, and rows for back-off weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import katz
from lanewise.llm.common import crc_bucket


def corpus():
    r = random.Random(7)
    vocab = ["w%d" % int(r.paretovariate(0.6)) for _ in range(20_000)]
    return [" ".join(r.choice(vocab) for _ in range(100)) for _ in range(2000)]


@pytest.fixture
def asked(spark, monkeypatch):
    """The tables that mapInPandas made during the run, by their columns; nothing is removed."""
    made = []
    kind = type(spark.range(1))
    map_in_pandas = kind.mapInPandas

    def kept(self, *args, **kwargs):
        made.append(map_in_pandas(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(kind, "mapInPandas", kept)
    monkeypatch.setattr(katz, "discard", lambda *tables: None)
    return made


def test_triples_are_asked_for_in_few_bytes(spark, asked):
    texts = corpus()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    assert katz.score_documents(table, crc_bucket("doc_id", 10) == 0, order=3).count() == len(texts)
    requests = next(x for x in asked if "v_counts" in x.columns)
    binary = [f.name for f in requests.schema.fields if f.dataType.typeName() == "binary"]
    size = requests.agg(F.sum(sum(F.octet_length(x) for x in binary))).first()[0]
    triples = {t for i, x in enumerate(texts) for w in [x.split() + [None]] for t in zip(w, w[1:], w[2:])}
    assert size < 5 * len(triples), size / len(triples)


def test_only_split_histories_are_joined(spark, monkeypatch):
    rows = []
    backoff, doubts = katz._backoff, katz._doubts

    def counted(build):
        def kept(*args):
            table = build(*args)
            rows.append(table.count())
            return table

        return kept

    monkeypatch.setattr(katz, "_backoff", counted(backoff))
    monkeypatch.setattr(katz, "_doubts", counted(doubts))
    table = spark.createDataFrame(list(enumerate(corpus()[:200])), "doc_id long, text string")
    katz.score_documents(table, crc_bucket("doc_id", 10) == 0, order=3).count()
    assert rows == [0, 0, 0, 0]
    katz.score_documents(table, crc_bucket("doc_id", 10) == 0, order=3, split_history=20, parts=5).count()
    assert all(rows[4:6]) and sum(rows[4:6]) < 2000  # few histories of one word are that frequent


def test_packing_leaves_out_zeros():
    r = np.random.default_rng(0)
    for values in (r.integers(0, 200, 5000).astype(np.uint64), r.random(50), np.array([2**64 - 1, 0], np.uint64), np.zeros(7, np.uint32), np.zeros(0, np.float64)):
        assert (katz.unpack(katz.pack(values), values.dtype) == values).all()
    assert len(katz.pack(r.integers(0, 200, 5000).astype(np.uint64))) < 5100


def test_ranked_codes():
    r = np.random.default_rng(1)
    for codes in (r.integers(0, 50, 300), r.integers(0, 2**62, 300).repeat(3), np.zeros(0, np.int64)):
        one, place = katz._ranked(codes)
        names, places = np.unique(codes, return_inverse=True)
        assert (codes[one] == names).all() and (place == places).all()
        names, places = katz._distinct(codes.astype(np.uint64))
        assert (names[places] == codes).all() and (np.diff(names.astype(np.int64)) > 0).all()


def test_large_ids_beside_a_null_id(spark):
    ids = [None, 2**60 + 1, -5, 2**62 + 3]
    table = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").repartition(1)
    got = katz.score_documents(table, F.col("doc_id") == -5, order=3).collect()
    assert {(g["doc_id"], g["held_out"]) for g in got} == {(i, i == -5) for i in ids}
