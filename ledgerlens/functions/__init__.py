"""LedgerLens functions."""
