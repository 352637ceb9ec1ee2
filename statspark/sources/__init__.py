"""Readers and sinks."""

from .files import read_table, write_result

__all__ = ["read_table", "write_result"]
