"""Registered queries. Importing this package fills ``REGISTRY``."""

from ticketflow.plans.registry import REGISTRY  # noqa: F401
from ticketflow.plans import kpi_queries  # noqa: F401
from ticketflow.plans import thread_queries  # noqa: F401
from ticketflow.plans import lifecycle_queries  # noqa: F401
from ticketflow.plans import text_queries  # noqa: F401
from ticketflow.plans import listing_queries  # noqa: F401
from ticketflow.plans import search_queries  # noqa: F401
from ticketflow.plans import stream_queries  # noqa: F401
from ticketflow.plans import table_queries  # noqa: F401
