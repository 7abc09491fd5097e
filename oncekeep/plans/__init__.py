"""Registered queries, their inputs built from the given tables, and their SQL counterparts."""
