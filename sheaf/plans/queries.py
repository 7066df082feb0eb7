"""All queries of the document engine."""

from sheaf.plans import core, documents, relations, rows, scalars, streams  # noqa: F401  (they register their queries)
from sheaf.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Texts to documents, written, opened again, read in order and searched."""
    return QUERIES["fn17_search_documents"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
