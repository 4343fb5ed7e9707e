"""Source relations (fixture views, warehouse tables) and the SQL extracts."""

from custseg.sources.relations import (
    ORDERS_AS_OF, READER_AS_OF, Sources, fixture_sources, table_sources, jdbc_sources,
)
from custseg.sources.extracts import (
    orders_extract, orders_non_premium, streaming_counts, segment_lookup,
    churn_labels, duplicate_keys,
)

__all__ = [
    "ORDERS_AS_OF", "READER_AS_OF", "Sources", "fixture_sources", "table_sources",
    "jdbc_sources", "orders_extract", "orders_non_premium", "streaming_counts",
    "segment_lookup", "churn_labels", "duplicate_keys",
]
