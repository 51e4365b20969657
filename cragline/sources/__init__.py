"""Readers and writers: point text, LAS, rasters, lines, reports, JSON documents."""
