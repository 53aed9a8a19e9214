"""Registered queries, each beside the SQL that gives the same rows."""
