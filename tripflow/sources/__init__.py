"""Readers and writers: trip tables, schedule feeds, table catalogue, map layers."""
