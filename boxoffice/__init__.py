"""Box-office analytics: reports, checks and change sets over ticketing tables, as Spark DataFrames."""

from boxoffice.sources.tables import Tables

__all__ = ["Tables"]
