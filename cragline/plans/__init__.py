"""Whole runs: automatic extraction, a clicked face, and the registry of queries."""
