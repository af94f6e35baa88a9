"""Readers and writers for logs, state tables and file inventories."""
