"""Names without title, other scripts, and more forms of phones and e-mails."""

import unicodedata

import pytest

from lanewise.llm import surrogates


def test_untitled_mentions_get_the_same_surrogate(spark):
    text = "Mr John Smith came. Smith said so; JOHN SMITH, Smith's dog and John Smith agree. Blacksmith Smithson stays. Mrs Weiß's car, Weiß."
    table = spark.createDataFrame([(1, text), (2, "Smith without a title")], "doc_id long, text string")
    got = {g["doc_id"]: g for g in surrogates.pseudonymise(table, "k").collect()}
    spans = got[1]["entities"]
    surnames = [e["surrogate"] for e in spans if e["kind"] == "surname"]
    given = [e["surrogate"] for e in spans if e["kind"] == "given_m"]
    john, smith, weiss = given[0], surnames[0], surnames[-1]
    assert got[1]["text"] == (
        f"Mr {john} {smith} came. {smith} said so; {john.upper()} {smith.upper()}, {smith}'s dog and {john} {smith} agree. "
        f"Blacksmith Smithson stays. Mrs {weiss}'s car, {weiss}."
    )
    assert "Smith " not in got[1]["text"] and got[2]["text"] == "Smith without a title"


@pytest.mark.parametrize("text,script", [("Mr Παπαδόπουλος", "GREEK"), ("Mrs محمود", "ARABIC"), ("г-н Петров", "CYRILLIC"), ("Herr Weiß", "LATIN")])
def test_names_keep_their_script(text, script):
    ((start, end, kind, normal),) = surrogates.entities(text)
    drawn = surrogates.surrogate(b"k", kind, normal, 0)
    assert drawn != normal and all(unicodedata.name(c).startswith(script) for c in drawn)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("call +14155551234 now", "phone", "+14155551234"),
        ("tel 01 23 45 67 89.", "phone", "01 23 45 67 89"),
        ("tel +33 1 23 45 67 89.", "phone", "+33 1 23 45 67 89"),
        ("请联系bob@example.com谢谢", "email", "bob@example.com"),
        ("to _bob@example.com", "email", "_bob@example.com"),
    ],
)
def test_more_forms_are_found(text, kind, found):
    assert [(k, text[a:b]) for a, b, k, _ in surrogates.entities(text)] == [(kind, found)]
    assert __import__("re").search(surrogates.HINT, text)
