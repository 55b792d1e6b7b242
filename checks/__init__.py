"""Queries over the given tables, each with its SQL where one exists."""
