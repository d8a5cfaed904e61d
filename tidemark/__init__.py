"""Ordered key-value tables with log-structured semantics, as DataFrame operations."""
