"""Named queries of the engine and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from heron.plans import access, corpus, crawl, detect, files, links, markup, mentions, more, packs, planted, robots, sites, stores, streams, tables, text, urls
from heron.session import ship


def shipped(query: Callable) -> Callable:
    """The query, with the package's modules given to the executors first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


FAMILIES = [urls, text, detect, corpus, links, access, markup, files, more, planted, robots, mentions, streams, stores, packs, crawl, sites, tables]
QUERIES: dict[str, Callable] = {k: shipped(v) for m in FAMILIES for k, v in m.R.queries.items()}
ORACLES: dict[str, str] = {k: v for m in FAMILIES for k, v in m.R.oracles.items()}
