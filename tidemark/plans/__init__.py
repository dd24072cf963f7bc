"""Queries that run the operators over the provided tables, each beside the SQL it must agree with."""
