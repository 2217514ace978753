"""Excerpts of long benchmark items."""

import random

from lanewise.llm import decontaminate


def words(seed, count, alphabet="abcdefghijklmnop"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(count)]


def test_excerpt_of_a_long_item_is_found(spark):
    item = words(1, 300)
    rows = [
        (1, " ".join(words(2, 200) + item[90:190] + words(3, 200))),  # a third of the item
        (2, " ".join(words(4, 50) + item[20:33] + words(5, 50))),
        (3, " ".join(words(6, 50) + item[20:29] + words(7, 50))),
        (4, " ".join(words(8, 600))),
    ]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {g["doc_id"]: g for g in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2}
    assert got[1]["start_word"] <= 200 and got[1]["end_word"] >= 300 and got[1]["score"] < 0.5
