"""Operators for preparing large text corpora, each a Spark job over whole tables.

The rest of the library does not import this subpackage, and it needs nothing of the rest.
Every operator takes DataFrames and returns DataFrames; ``queries`` binds them to the tables.
"""
