"""Registered queries, one module per family of operators."""
