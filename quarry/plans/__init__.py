"""Registered queries, each with SQL where SQL can express it."""
