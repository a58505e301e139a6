"""The query catalogue: a Spark callable per name and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Entry] = {}
CTES: dict[str, str] = {}
#: Blocks that are worth computing once where several others read them.
KEPT: set[str] = set()


def cte(name: str, body: str, keep: bool = False) -> None:
    """A named SQL building block; the ones an oracle mentions are put in its WITH clause."""
    CTES[name] = body.strip()
    if keep:
        KEPT.add(name)


def with_ctes(body: str) -> str:
    needed: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in path:
                raise ValueError(f"SQL block {word} mentions itself: {path}")
            if word in CTES and word not in needed:
                visit(CTES[word], (*path, word))
                needed.append(word)

    visit(body, ())
    if not needed:
        return body.strip()
    chain = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}(\n{CTES[n]}\n)" for n in needed)
    return f"WITH {chain}\n{body.strip()}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Entry(fn, sql)
        return fn
    return register


def r6(*names: str):
    """Columns as doubles rounded to six digits, the precision results are compared at."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def big(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]
