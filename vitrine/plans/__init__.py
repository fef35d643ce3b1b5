"""Plans: the operators put together over tables, registered with their SQL twins."""

from __future__ import annotations


def queries() -> dict:
    from vitrine.plans import registry, star_filters, star_linked, star_museum, star_reconcile, star_records, star_stats, star_streams, star_texts  # noqa: F401  importing registers

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from vitrine.plans import registry

    return dict(registry.SQL)
