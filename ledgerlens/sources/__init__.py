"""Readers and writers of tables."""

from ledgerlens.sources.tables import read_table

__all__ = ["read_table"]
