"""All checked queries."""

from checks import catalog_analysis, catalog_lines, catalog_reports, catalog_training  # noqa: F401
from checks.registry import CHECKS

__all__ = ["CHECKS"]
