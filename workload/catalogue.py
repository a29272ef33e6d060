"""Imports every query module so that the registry is complete."""

from . import artifact_queries, evidence_queries, finding_queries, http_queries, mapping_queries, selection_queries, surface_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
