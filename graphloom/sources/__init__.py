"""Readers and writers of tables, reports and manifests."""
