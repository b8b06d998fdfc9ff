"""Registered queries, each with the SQL that an independent engine can run."""
