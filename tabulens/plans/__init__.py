"""Whole analyses, and queries that bind every operator to tables at hand."""
