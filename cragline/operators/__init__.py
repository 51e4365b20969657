"""Operators over points, grid cells and polyline vertices. Each takes and returns DataFrames."""
