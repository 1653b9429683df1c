"""Every operator as a named query over the star-schema tables, with its check SQL where SQL can say it."""

from wattshelf.plans.catalog import (  # noqa: F401  (each module registers its queries)
    models,
    monitoring,
    products,
    relations,
    series,
    streams,
    texts,
)
from wattshelf.plans.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
