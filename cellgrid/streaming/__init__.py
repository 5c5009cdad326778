"""Cubes kept up by streams."""
