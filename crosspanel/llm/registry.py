"""Every query of this folder and its SQL."""

from . import decontamination, extraction, filters, fingerprints, jaccard, licenses, lines, links, packing, pii, substrings, toxicity, tries  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
