"""Named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

NUDGE = 1e-9

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common table expressions, in dependency order.
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def table(name: str, body: str, *needs: str) -> None:
    _TABLES[name] = (needs, body.strip())


def _needed(name: str, seen: list[str]) -> None:
    for other in _TABLES[name][0]:
        _needed(other, seen)
    if name not in seen:
        seen.append(name)


def sql(select: str, *tables: str, recursive: bool = False) -> str:
    """A statement with the tables it uses put in front."""
    seen: list[str] = []
    for name in tables:
        _needed(name, seen)
    head = ",\n".join(f"{name} AS (\n{_TABLES[name][1]}\n)" for name in seen)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} {head}\n{select.strip()}" if head else select.strip()


def rd(expression: str, name: str, places: int = 6) -> str:
    """Rounded SQL column, the counterpart of ``rounded``."""
    return f"round(({expression}) + {NUDGE}, {places}) AS {name}"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, so that another order of summation gives the same value.

    Means of two-decimal numbers often end in an exact half; the nudge takes them all off it.
    """
    return df.select(
        *[
            F.round(F.col(f"`{c}`") + F.lit(NUDGE), places).alias(c) if kind == "double" else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


def query(name: str, oracle: str | None = None, places: int | None = 6):
    """Register a query; its doubles are rounded unless ``places`` is None."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df if places is None else rounded(df, places)

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
