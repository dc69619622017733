"""The catalogue of registered queries: name, Spark plan, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.fixtures import FX, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_inputs(sql: str) -> str:
    """SQL whose fx_<name> tables are defined in front."""
    names = [n for n in FX if re.search(rf"\bfx_{n}\b", sql)]
    heads = ",\n".join(f"fx_{n} AS ({duck(n)})" for n in names)
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    return f"WITH {heads},\n{body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a plan under a name, with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return f

    return add
