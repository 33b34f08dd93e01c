"""Queries by name, each with the SQL that must give the same rows."""

from .plans import claims, disclosures, discovery, facts, filings, identity, outcomes, positions, records, scalars, series, statements, stores, text, vision, windows  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
