"""Service-operations analytics over device fleets, as lazy PySpark DataFrames."""

from fleetlens.filters import Filters
from fleetlens.sources.tables import Tables

__all__ = ["Filters", "Tables"]
