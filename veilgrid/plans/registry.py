"""Query registry: a Spark plan and, where SQL can say it, the equivalent text for a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounding(spec: str) -> dict[str, int]:
    """'a b:2' -> {'a': 6, 'b': 2}"""
    out = {}
    for item in spec.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits or 6)
    return out


def _closure(names: list[str]) -> list[str]:
    """The named views and those they build on, in definition order."""
    need: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += SQL_VIEWS[n][0]
    return [n for n in SQL_VIEWS if n in need]


def oracle_text(sql: str, views: str, rnd: dict[str, int], ints: list[str]) -> str:
    ctes = [f"{n} as ({SQL_VIEWS[n][1]})" for n in _closure(views.split())]
    ctes.append(f"answer as ({sql})")
    fixes = [f"round({c}, {d}) + 0e0 as {c}" for c, d in rnd.items()] + [f"cast({c} as bigint) as {c}" for c in ints]
    star = f"* replace ({', '.join(fixes)})" if fixes else "*"
    return f"with {', '.join(ctes)} select {star} from answer"


def query(name: str, sql: str | None = None, views: str = "", rnd: str = "", ints: str = ""):
    """Register a plan. Both sides round ``rnd`` columns and make ``ints`` columns BIGINT."""
    digits, whole = _rounding(rnd), ints.split()

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            fixes = {c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()}
            fixes |= {c: F.col(c).cast("bigint") for c in whole}
            return df.withColumns(fixes) if fixes else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_text(sql, views, digits, whole)
        return fn

    return wrap
