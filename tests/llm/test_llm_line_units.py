"""Repeats in paragraphs of short lines and in text without spaces."""

import random

from lanewise.llm import line_dedup


def words(seed, count, alphabet="abcdefghijklmnop"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(count)]


def test_paragraphs_of_short_lines_and_lines_without_spaces(spark):
    verse = "\n".join(" ".join(words(20 + k, 2)) for k in range(30))
    wrapped = " ".join(verse.split())
    chinese = "这是一个没有空格的很长的句子并且在许多文件中重复出现"
    rows = [
        (1, f"one\n\n{verse}\n\n{chinese}\nyes\nno"),
        (2, f"two\n\n{verse.upper()}\n\nmiddle of it\nyes\n{chinese}\nlast"),
        (3, f"three\n{wrapped}\nyes\nno"),
        (4, verse),
    ]
    got = {g["doc_id"]: g for g in line_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed"] == []
    assert got[2]["text"] == "two\n\n\nmiddle of it\nyes\nlast"
    assert got[3]["text"] == "three\nyes\nno"
    assert got[4]["text"] == "" and len(got[4]["removed"]) == 1
    for i, text in rows:
        assert got[i]["text"] == "".join(text[k["start"] : k["end"]] for k in got[i]["kept"])
        spans = sorted((x["start"], x["end"]) for x in [*got[i]["kept"], *got[i]["removed"]])
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(text)
