"""All registered queries."""

from panelforge.plans import event_queries, io_queries, iterative_queries, join_queries, panel_queries, record_queries, scalar_queries, score_queries  # noqa: F401
from panelforge.plans.base import ORACLE_SQL, QUERIES, SURVEY  # noqa: F401

ENTRY = "onset_growth_summary"
