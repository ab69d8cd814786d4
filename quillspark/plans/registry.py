"""Every registered query of the library's own operators, with its SQL twin."""

from __future__ import annotations

from quillspark.plans import q_comparing, q_measures, q_mining, q_reports, q_rewrites, q_streams  # noqa: F401
from quillspark.plans.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
