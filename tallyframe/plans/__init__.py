"""Assembled tables and the registered queries."""
