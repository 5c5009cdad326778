"""Specs, routing of queries to cubes, comparison of results, timing."""
