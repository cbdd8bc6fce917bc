"""The registered queries: each binds operators to the tables of a data directory, with SQL to check it where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# WS of functions.text as the oracle's regular expressions take it
SQL_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL_LATEST = "latest AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY doc_id DESC) = 1)"
SQL_ATTEMPTS = "att AS (SELECT DISTINCT * FROM attempts)"
SQL_PASSAGES = "pas AS (SELECT DISTINCT * FROM passages)"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_WS}+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable:
    """Registers the function under its own name. It takes a reader of tables by name."""

    def add(make: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        name = make.__name__
        QUERIES[name] = lambda spark, sf_dir: make(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE[name] = re.sub(r"\n\s*", "\n", sql.strip())
        return make

    return add
