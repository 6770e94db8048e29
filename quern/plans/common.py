"""Helpers for registering a query beside its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.views import TABLES, table

#: Functions whose spelling differs: name -> (Spark, DuckDB); arguments have no nested calls with commas.
SPELLED = {
    "MILLIS": ("unix_millis(CAST({0} AS TIMESTAMP))", "(epoch_us({0}) // 1000)"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "IDIV": ("({0} div {1})", "({0} // {1})"),
    "JGET": ("get_json_object({0}, {1})", "json_extract_string({0}, {1})"),
    "AGGSTR": ("array_join(array_sort(collect_list({0})), ',')", "string_agg({0}, ',' ORDER BY {0})"),
    "REPALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
}


def spelled(text: str, engine: int) -> str:
    """text with each NAME(a ; b) of SPELLED in one engine's spelling, innermost last."""
    for name, forms in SPELLED.items():
        while m := re.search(rf"\b{name}\(", text):
            depth, end = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            args = [x.strip() for x in text[m.end() : end - 1].split(" ; ")]
            text = text[: m.start()] + forms[engine].format(*args).replace(name + "(", name.lower() + "(") + text[end:]
    return text


class Book:
    """Queries and oracles of one module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str) -> None:
        """A query that Spark and DuckDB share but for spelling; tables stand for themselves."""
        used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", spelled(text, 0))
            return spark.sql(made, **{t: table(spark, sf_dir, t) for t in used})

        self.queries[name] = run
        self.oracles[name] = spelled(text, 1)

    def query(self, name: str, oracle: str | None = None):
        """Decorator: a DataFrame query, with its oracle."""

        def put(run):
            self.queries[name] = run
            if oracle:
                self.oracles[name] = spelled(oracle, 1)
            return run

        return put
