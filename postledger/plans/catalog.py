"""All registered queries and their SQL."""

from postledger.plans import check_queries, intake_queries, queries, report_queries, search_queries, signal_queries  # noqa: F401  they register
from postledger.plans.registry import QUERIES, SQL  # noqa: F401
