"""Queries of the subpackage, one module a problem."""
