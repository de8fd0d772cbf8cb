"""Incremental and continuous runs."""
