"""Queries over the given tables, one for each operator, and the SQL that each is held against."""
