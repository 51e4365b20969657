"""Incremental forms of operators whose state adds up."""
