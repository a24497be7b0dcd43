"""Registered queries, one module per operator group."""
