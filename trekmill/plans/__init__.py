"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from trekmill.plans import guides, packages, places, sets, texts, times, transit  # noqa: F401
from trekmill.plans.base import ORACLE, QUERIES  # noqa: F401
