"""Registered queries: each applies an operator to whole tables, beside the SQL that gives the same rows."""
