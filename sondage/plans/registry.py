"""All queries of the library outside ``llm``, by name, with the SQL that checks them."""

from __future__ import annotations

from sondage.plans import anonymising, cleaning, clusters, profiling, questionnaires, sources, streams  # noqa: F401
from sondage.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
