"""Readers that turn tables, files, diffs, dumps and histories into chunks."""
