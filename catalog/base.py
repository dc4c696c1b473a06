"""Registry of checked queries: a Spark callable, an output contract and, if any, the oracle SQL.

The output contract is a string of ``name:kind`` items (s text, t date as ISO text, i bigint,
d double rounded to six places). It is applied to both sides, so names and types agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Averages can fall exactly between two sixth decimals, where the last bit of a sum would decide the
# rounding. Both sides move by this much first, which puts such values on one side.
TIE = 3e-10

SparkQuery = Callable[[SparkSession, str], DataFrame]
CTES: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    spark: SparkQuery
    oracle: str | None


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(needs: str, body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0].split():
            visit(dep)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return body
    listed = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {listed}\n{body}"


def _items(contract: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in contract.split()]


def spark_output(df: DataFrame, contract: str) -> DataFrame:
    out = []
    for name, kind in _items(contract):
        c = F.col(f"`{name}`")
        if kind == "d":
            r = F.round(c.cast("double") + TIE, 6)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def sql_output(body: str, contract: str) -> str:
    out = []
    for name, kind in _items(contract):
        c = f'"{name}"'
        if kind == "d":
            r = f"round(CAST({c} AS DOUBLE) + {TIE!r}, 6)"
            c = f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END"
        elif kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "t":
            c = f"strftime({c}, '%Y-%m-%d')"
        out.append(f'{c} AS "{name}"')
    return "SELECT " + ", ".join(out) + f"\nFROM (\n{body}\n) AS final_rows"


def query(name: str, operators: str, contract: str, needs: str = "", sql: str | None = None):
    """Decorator that registers a Spark query with its contract and oracle."""

    def register(fn: SparkQuery) -> SparkQuery:
        run = lambda spark, folder: spark_output(fn(spark, folder), contract)
        oracle = None if sql is None else with_ctes(needs, sql_output(sql, contract))
        if sql is not None:
            CTES[f"q_{name}"] = (needs, sql)  # other oracles may build on this result
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, operators, run, oracle)
        return fn

    return register


def dbl(value: float) -> str:
    """A double literal (a plain decimal literal would be a DECIMAL)."""
    return f"CAST('{value!r}' AS DOUBLE)"


KEYSPEC = "subject_id:s sleep_date:t lifelog_date:t"
DAYSPEC = "subject_id:s lifelog_date:t"


def columns(kind: str, names: list[str]) -> str:
    return " ".join(f"{n}:{kind}" for n in names)
