"""Readers that produce the input tables: source files, change listings, diffs, model responses."""
