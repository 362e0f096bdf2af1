"""Incremental runs of the row-local stages."""
