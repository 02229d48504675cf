"""Pieces that the query modules share."""

from __future__ import annotations

from shelfmark.plans import pipelines
from shelfmark.session import shared_path
from shelfmark.sources import sinks
from shelfmark.sources.tables import table

#: The current row of every id, in SQL; CTE ``cur``.
CUR = """cur as (select * exclude (_rn) from (select *, row_number() over (partition by id order by harvested_at desc nulls last, ingested_at desc nulls last) _rn
 from seda_dataset where id is not null) where _rn = 1)"""

#: A Unicode blank in RE2.
WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def registry():
    """(queries, oracles, decorator)."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def store_copy(spark, folder, *names):
    """Stores in the shared folder that hold copies of some tables: what a pipeline may write to."""
    stores = pipelines.Stores(spark, shared_path(spark, "store"))
    for n in names:
        sinks.append(table(spark, folder, n), stores.path(n))
    return stores
