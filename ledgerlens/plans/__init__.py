"""LedgerLens plans."""
