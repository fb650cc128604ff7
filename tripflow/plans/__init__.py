"""Whole jobs: the derived inputs, the named queries and their SQL oracles."""
