"""Imports every query module, so that the registry is complete."""

from tandem.plans import q_catalog, q_claims, q_documents, q_history, q_rows, q_security, q_stream  # noqa: F401
from tandem.plans.registry import ORACLES, QUERIES  # noqa: F401
