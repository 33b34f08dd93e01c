"""Queries, each beside the SQL that must give the same rows."""
