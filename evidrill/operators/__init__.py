"""Operators on DataFrames: preparation, curation, models, fusion, comparison, diagnostics, networks."""
