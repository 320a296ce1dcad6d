"""Every operator as a query over the driver's tables, with SQL that says the same."""

from rolefunnel.plans.catalog import (  # noqa: F401  (importing registers the queries)
    boards,
    dates_labels,
    duplicates,
    external,
    feeds,
    ranking,
    selections,
    stores,
    streams,
    texts,
)
from rolefunnel.plans.catalog.base import CATALOG  # noqa: F401
