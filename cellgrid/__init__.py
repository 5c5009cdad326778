"""Cubes of entity sets, built, merged, checked and queried with Spark DataFrames."""
