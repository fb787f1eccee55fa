"""Registered queries, one per inventoried operator, with their SQL oracles."""
