"""All registered queries. Importing the modules fills the registry."""

from loadweave.catalog.registry import QUERIES, SQL
from loadweave.catalog import cleaning, features, forecasting, models, profiling  # noqa: F401

__all__ = ["QUERIES", "SQL"]
