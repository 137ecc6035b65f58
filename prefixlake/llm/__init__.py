"""Training-data operators: quality, language, near duplicates, packing, mixing and the rest.

Nothing outside this package imports it. ``queries()`` and ``oracles()`` list what the driver may run.
"""

from __future__ import annotations


def queries() -> dict:
    """The ``opN_<name>`` queries; each takes (spark, sf_dir) and returns a DataFrame."""
    from prefixlake.llm import catalog

    return dict(catalog.QUERIES)


def oracles() -> dict[str, str]:
    """DuckDB text of those queries that SQL can express."""
    from prefixlake.llm import catalog

    return dict(catalog.ORACLES)
