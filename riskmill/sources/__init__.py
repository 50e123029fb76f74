"""Ledger readers, adapters and table sinks."""
