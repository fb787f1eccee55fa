"""Relational, ranking, curation and metric operators over DataFrames."""
