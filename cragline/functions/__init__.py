"""Column expressions shared by the terrain operators."""
