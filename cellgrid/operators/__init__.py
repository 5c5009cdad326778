"""Operators over DataFrames: ingest, validation, ids, cubes, facts, joins."""
