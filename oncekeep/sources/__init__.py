"""Readers and writers for orders, the ledger, snapshots and exports."""
