"""Incremental alignment of arriving proteins."""
