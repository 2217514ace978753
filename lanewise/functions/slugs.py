"""Street name to file-safe key: the canonical rule and two older ones.

The accent table is derived from Unicode decomposition on the driver and becomes one
``translate`` literal, so no Python runs per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions.calendar import col


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every character whose decomposition is one ASCII letter or digit plus marks."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        plain = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0].isascii() and plain[0].isalnum():
            source.append(char)
            target.append(plain[0])
    return "".join(source), "".join(target)


def strip_marks(text: Column | str) -> Column:
    """Remove accents, composed or combining."""
    return F.regexp_replace(F.translate(col(text), *_accent_table()), r"\p{M}", "")


def slug(name: Column | str) -> Column:
    """Canonical key: Đ and ð count as d, runs of other characters become one underscore."""
    plain = strip_marks(F.translate(F.coalesce(col(name), F.lit("")), "ĐđÐð", "DdDd"))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), F.lit("_"))


def slug_ascii_only(name: Column | str) -> Column:
    """Older key: characters without an ASCII form vanish, so Đ is dropped."""
    ascii_text = F.regexp_replace(strip_marks(name), r"[^\x00-\x7F]", "")
    spaced = F.replace(F.lower(ascii_text), F.lit(" "), F.lit("_"))
    return F.regexp_replace(spaced, r"""[/\\,.:;()'"]""", "")


def slug_keep_letters(name: Column | str) -> Column:
    """Older key: any letter or digit stays, so đ survives."""
    spaced = F.replace(F.lower(strip_marks(F.trim(col(name)))), F.lit(" "), F.lit("_"))
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", "")
