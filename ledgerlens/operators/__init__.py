"""LedgerLens operators."""
