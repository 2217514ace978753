"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by patterns, and persons once named with a title also where the same text has
their full name or surname without one. They are reduced to a normal form (digits, or lower case), so that two
spellings of one entity get one surrogate. A surrogate is drawn from a keyed hash of kind, normal
form and attempt, and written in the layout of the original. The distinct entities of the corpus
are checked as a table: a surrogate that another entity has, or that is itself a real entity, is
drawn again with the next attempt.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.session import stored

# Forms of address with the gender they tell, and given names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Signora", "г-жа", "госпожа")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Marco", "Oscar"),
    ("latin", "f"): ("Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Irene", "Julia", "Laura", "Maria", "Nora"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Иван", "Олег", "Павел"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"),
}
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeio"],
    "cyrillic": [c + v for c in "бвгдклмнпрст" for v in "аеио"],
}

_NAME = r"[^\W\d_]+(?:[-'][^\W\d_]+)?"
_TITLES = "|".join(sorted(map(re.escape, MALE_TITLES + FEMALE_TITLES), key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}"
    r"|\+[0-9]{8,15}|(?:\+[0-9]{1,3}[ .-]?[0-9]{1,2}|[0-9]{2})(?:[ .-][0-9]{2}){4})(?![\w-])",
    "name": rf"\b(?P<title>{_TITLES})\.? (?P<names>{_NAME}(?: {_NAME})?)",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
# What every match contains, for the JVM to tell texts that cannot have one.
HINT = rf"@|[0-9][^A-Za-z]{{5}}|[A-Z]{{2}}[0-9]{{2}}|{_TITLES}"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _script(word: str) -> str:
    """Script of a word's first letter outside A-Z, as Unicode names it; latin without one."""
    for c in word:
        if c.isalpha() and not c.isascii():
            name = unicodedata.name(c, "LATIN").split()[0]
            if name != "LATIN":
                return name.lower()
    return "latin"


def _letters(word: str, script: str) -> list[str]:
    """Lower-case letters, or letters without case, in the Unicode block of a word's script."""
    at = next(ord(c) for c in word if _script(c) == script) & ~127
    return [chr(c) for c in range(at, at + 128) if unicodedata.category(chr(c)) in ("Ll", "Lo") and _script(chr(c)) == script]


def _capital(word: str) -> bool:
    """Whether a word can be a name: it begins with a capital, or with a letter without case."""
    return word[0].isupper() or unicodedata.category(word[0]) == "Lo"


def entities(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and normal form of the entities of a text, left to right.

    Full names and surnames that follow a title are found without it as well, anywhere in the text.
    """
    found, names = [], {}
    for m in _FIND.finditer(text) if text else ():
        value = m[0]
        kind = next(k for k in PATTERNS if m[k] is not None)
        if kind == "name":
            gender = "m" if m["title"] in MALE_TITLES else "f"
            words = list(re.finditer(r"[^ ]+", m["names"]))
            words = [w for w in words if _capital(w[0])]
            if len(words) == 2 and words[1].start() != words[0].end() + 1 or not _capital(m["names"]):
                words = words[:0]
            spans = []
            for k, w in enumerate(words):
                part = "surname" if k == len(words) - 1 else f"given_{gender}"
                start = m.start("names") + w.start()
                name = re.sub("'[sS]$", "", w[0])  # Smith's is Smith
                spans.append((start, start + len(name), part, name.lower()))
            found += spans
            if spans:
                names[text[spans[-1][0] : spans[-1][1]]] = [spans[-1][2:]]
                names[" ".join(text[a:b] for a, b, *_ in spans)] = [x[2:] for x in spans]
        elif kind in ("card", "ssn", "phone"):
            found.append((m.start(), m.end(), kind, re.sub("[^0-9]", "", value)))
        else:
            found.append((m.start(), m.end(), kind, value.replace(" ", "").lower()))
    yield from sorted(found + list(_mentions(text, names, found))) if names else found


def _mentions(text: str, names: dict[str, list[tuple[str, str]]], found: list) -> Iterator[tuple[int, int, str, str]]:
    """The names, as written or in capitals, where nothing is found yet; the longest first."""
    known = {form: parts for name, parts in names.items() for form in (name.upper(), name)}
    forms = sorted(known, key=len, reverse=True)
    spans, k = sorted(found), 0
    for m in re.finditer(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, forms))})(?![^\W_])", text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            continue
        at = m.start()
        for word, (kind, normal) in zip(m[0].split(" "), known[m[0]]):
            yield at, at + len(word), kind, normal
            at += len(word) + 1


class _Draws:
    """Numbers drawn from a keyed hash, the same on every machine."""

    def __init__(self, key: bytes, *parts):
        self.seed, self.key, self.count, self.pool = "\x1f".join(map(str, parts)).encode(), key, 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.count += 1
            digest = hmac.new(self.key, self.seed + b"\x1f%d" % self.count, hashlib.sha256).digest()
            self.pool, self.left = int.from_bytes(digest, "big"), 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def _like(c: str, draws: _Draws) -> str:
    if c.isdigit():
        return str(draws.below(10))
    return chr(97 + draws.below(26)) if c.isalpha() and c.isascii() else c


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """Normal form of the surrogate: of the kind's format, and valid when the original is."""
    draws = _Draws(key, kind, normal, attempt)
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        labels = domain.split(".")
        named = _Draws(key, "domain", domain)
        labels[:-1] = ["".join(_like(c, named) for c in label) for label in labels[:-1]]
        more = "".join(_like("a", draws) for _ in range(attempt // 4))  # a short part may have no free form
        return "".join(_like(c, draws) for c in local) + more + "@" + ".".join(labels)
    if kind == "ip":
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if kind == "card":
        body = normal[0] + "".join(str(draws.below(10)) for _ in normal[1:-1])
        good = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (good if luhn(normal) else str((int(good) + 1 + draws.below(9)) % 10))
    if kind in ("ssn", "phone"):
        keep = max(0, len(normal) - 10) if kind == "phone" else 0  # the country code
        return normal[:keep] + str(1 + draws.below(8)) + "".join(str(draws.below(10)) for _ in normal[keep + 1 :])
    if kind == "iban":
        body = "".join(_like(c, draws) for c in normal[4:])
        number = int("".join(str(int(c, 36)) for c in body + normal[:2] + "00"))
        return f"{normal[:2]}{98 - number % 97:02d}{body}"
    script = _script(normal)
    if script not in SYLLABLES:
        letters = _letters(normal, script)
        return "".join(letters[draws.below(len(letters))] for _ in range(max(4, len(normal)) + attempt // 4))
    if kind.startswith("given_") and attempt < 8:
        names = GIVEN[script, kind[-1]]
        return names[draws.below(len(names))].lower()
    parts = SYLLABLES[script]
    tail = ("a" if script == "latin" else "а") if kind == "given_f" else ""
    return "".join(parts[draws.below(len(parts))] for _ in range(3 + attempt // 4)) + tail


def laid_out(original: str, kind: str, normal: str) -> str:
    """A normal form written in the layout and letter case of the original."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(normal)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "iban":
        signs = iter(normal.upper())
        return "".join(c if c == " " else next(signs) for c in original)
    if original.isupper() and len(original) > 1:
        return normal.upper()
    if kind in ("surname",) or kind.startswith("given_"):
        return normal[:1].upper() + normal[1:]
    if len(original) == len(normal):
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, normal))
    return normal


def assign(found: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """``kind``, ``normal``, ``surrogate``: distinct per kind, and no real entity of the kind.

    ``found`` has the distinct (kind, normal). The entities still open shrink with every round;
    a kind whose surrogates run out is an error rather than a shared surrogate.
    """

    @F.pandas_udf("string")
    def draw(kind: pd.Series, normal: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kind, normal, attempt)], dtype=object)

    real = found.select("kind", F.col("normal").alias("surrogate"))
    settled = None
    open_ = found
    for attempt in range(rounds):
        drawn = open_.withColumn("surrogate", draw("kind", "normal", F.lit(attempt)))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal")), "surrogates")
        won = won.select("kind", "normal", "surrogate")
        settled = won if settled is None else settled.union(won)
        open_ = stored(open_.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"), "open-entities")
        if open_.isEmpty():
            return settled
    raise ValueError(f"no free surrogate after {rounds} attempts")


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` with surrogates, ``n_entities``, ``entities`` (start, end, kind, surrogate).

    Spans are code points of the original text with the end exclusive. Equal entities get equal
    surrogates in all documents, different ones never do. Null and empty texts, null ids and
    repeated rows are carried through; other columns are ignored.
    """
    secret = key.encode()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    may = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    row_key: Column = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))
    hinted = docs.where(may).withColumn("row_key", row_key)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *e) for k, t in zip(batch["row_key"], batch["text"]) for e in entities(t)]
            yield pd.DataFrame(rows, columns=["row_key", "start", "end", "kind", "normal"])

    spans = stored(
        hinted.select("row_key", "text").mapInPandas(find, "row_key string, start int, end int, kind string, normal string"),
        "entities",
    )
    given = assign(stored(spans.select("kind", "normal").distinct(), "distinct-entities"), secret)
    per_row = (
        spans.distinct().join(given, ["kind", "normal"]).groupBy("row_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("found"))
    )
    kinds = "array<struct<start:int,end:int,kind:string,surrogate:string>>"

    @F.pandas_udf(f"text string, entities {kinds}")
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for value, spans in zip(texts, found):
                pieces, at, shown = [], 0, []
                for span in spans if spans is not None else ():
                    new = laid_out(value[span["start"] : span["end"]], span["kind"], span["surrogate"])
                    pieces += [value[at : span["start"]], new]
                    at = span["end"]
                    shown.append({**span, "surrogate": new})
                out.append(("".join([*pieces, value[at:]]), shown))
            yield pd.DataFrame(out, columns=["text", "entities"])

    changed = hinted.join(per_row, "row_key", "left").withColumn("new", rewrite("text", "found"))
    none = F.expr(f"cast(array() as {kinds})")
    return changed.select("doc_id", "new.text", F.size("new.entities").cast("long").alias("n_entities"), "new.entities").union(
        docs.where(~may).select("doc_id", "text", F.lit(0).cast("long"), none)
    )
