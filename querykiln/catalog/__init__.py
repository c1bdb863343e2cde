"""All registered queries: name -> (Spark query, DuckDB SQL)."""

from __future__ import annotations


def all_queries() -> dict:
    from querykiln.catalog import dataset, evaluation, warehouse

    out: dict = {}
    for module in (warehouse, dataset, evaluation):
        out.update(module.QUERIES)
    return out
