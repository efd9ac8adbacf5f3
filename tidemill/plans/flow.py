"""Queries as chains of named SELECTs, planned by Catalyst as one statement.

A step is a SELECT over tables (``{table}``) and other steps (by name). A query needs its
own SELECT only: the steps that it names are put before it as common table expressions,
so operators are written once and composed by name. A query is held against a DuckDB
statement: one of its own, written with other constructs, where ``pair`` gives it, and
else the same text with the few words that differ. The steps below it are shared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.scratch import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Words that differ between Spark's SQL and DuckDB's.
_DUCKDB = (
    (r"\bpercentile\(", "quantile_cont("),
    (r"\bstruct\(", "row("),
    (r"\barray\(", "list_value("),
    (r"\bexplode\(sequence\(", "unnest(generate_series("),
    (r"\bget_json_object\(", "json_extract_string("),
    (r"\bsignum\(", "sign("),
    (r"\b(first_value|last_value)\(([^()]+)\) ignore nulls", r"\1(\2 ignore nulls)"),
    (r"\bcollect_list\(", "list("),
)
_NAME = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)\b")


class Flow:
    """A set of steps and the queries over them."""

    def __init__(self) -> None:
        self.steps: dict[str, str] = {}
        self.queries: dict[str, str] = {}
        self.oracles: dict[str, str] = {}
        self.stored: list[str] = []

    def step(self, **steps: str) -> None:
        for name, text in steps.items():
            if name in self.steps or name in TABLES:
                raise ValueError(f"a step or table is already named {name}")
            self.steps[name] = " ".join(text.split())

    def query(self, **queries: str) -> None:
        for name, text in queries.items():
            self.queries[name] = " ".join(text.split())

    def pair(self, **pairs: tuple[str, str]) -> None:
        """Queries with a DuckDB statement of their own over the same steps."""
        for name, (text, other) in pairs.items():
            self.query(**{name: text})
            self.oracles[name] = " ".join(other.split())

    def statement(self, text: str, cut: frozenset[str] = frozenset()) -> str:
        """``text`` after the steps that it names, directly or through others; those in ``cut`` are tables."""
        order: list[str] = []

        def visit(sql: str) -> None:
            for name in dict.fromkeys(_NAME.findall(sql)):
                if name in self.steps and name not in order and name not in cut:
                    visit(self.steps[name])
                    if name not in order:
                        order.append(name)

        visit(text)
        table = lambda sql: _NAME.sub(lambda m: f"{m[0][: -len(m[1])]}{{{m[1]}}}" if m[1] in cut else m[0], sql)
        if not order:
            return table(text)
        return "WITH " + ", ".join(f"{n} AS ({table(self.steps[n])})" for n in order) + " " + table(text)

    def store(self, *names: str) -> None:
        """Steps that are written once where a query reads them more than once."""
        self.stored.extend(names)

    def _reads(self, text: str) -> dict[str, int]:
        """How often each stored step is read, with every step put in where it is named."""
        found: dict[str, int] = {}
        for name in _NAME.findall(text):
            if name in self.steps:
                for k, n in self._reads(self.steps[name]).items():
                    found[k] = found.get(k, 0) + n
                if name in self.stored:
                    found[name] = found.get(name, 0) + 1
        return found

    def run(self, text: str, dealt: dict[str, str] | None = None, first: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
        """The query of ``text``. Tables in ``dealt`` are shuffled once, by the column named, so that groups and windows by it need no other shuffle. Steps in ``first`` are written once, too."""
        reads, dealt = self._reads(text), dealt or {}
        # in the order of ``stored``: a step may read those before it
        first = [*first, *(n for n in self.stored if reads.get(n, 0) > 1 and n not in first)]
        parts = [(n, self.statement(self.steps[n], frozenset(first[:i]))) for i, n in enumerate(first)] + [("", self.statement(text, frozenset(first)))]

        def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
            found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return found.repartition(dealt[name]) if name in dealt else found

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            for name, sql in parts:
                used = [t for t in (*TABLES, *made) if f"{{{t}}}" in sql]
                found = spark.sql(sql, **{t: made[t] if t in made else table(spark, sf_dir, t) for t in used})
                if name:
                    made[name] = stored(found, name)
            return found

        return query

    def duckdb(self, text: str) -> str:
        return _to_duckdb(self.statement(text))

    def oracle(self, name: str) -> str:
        """The DuckDB statement of a query."""
        text = self.oracles.get(name)
        if text is None:
            return self.duckdb(self.queries[name])
        whole = self.statement(text)
        head = _to_duckdb(whole[: len(whole) - len(text)])
        text = re.sub(r"\{(\w+)\}", r"\1", text)
        # tables of its own follow the steps in one list
        if text.startswith("WITH RECURSIVE "):
            return f"{head.rstrip().replace('WITH ', 'WITH RECURSIVE ', 1)}, {text.removeprefix('WITH RECURSIVE ')}"
        return f"{head.rstrip()}, {text.removeprefix('WITH ')}" if head and text.startswith("WITH ") else head + text

    def registered(self) -> tuple[dict[str, Callable], dict[str, str]]:
        return {n: self.run(t) for n, t in self.queries.items()}, {n: self.oracle(n) for n in self.queries}


def _to_duckdb(sql: str) -> str:
    sql = re.sub(r"\{(\w+)\}", r"\1", sql)
    for pattern, other in _DUCKDB:
        sql = re.sub(pattern, other, sql)
    return sql
