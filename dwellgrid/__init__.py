"""Space usage analytics on Spark: event logs and a space dimension in, DataFrames out."""

from dwellgrid.usage import Usage

__all__ = ["Usage"]
