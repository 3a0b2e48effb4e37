"""Registered queries, one module a family of operators."""
