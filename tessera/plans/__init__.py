"""All queries of the engine's own operators, by name."""

from tessera.plans import budgets, chunks, curation, documents, evidence, files, lookups, overview, reports, search, selection, text, traces, validation, vectors  # noqa: F401
from tessera.plans.base import ORACLES, QUERIES  # noqa: F401
