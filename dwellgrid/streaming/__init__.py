"""Incremental forms of the hourly roll-up and of the latest state."""
