"""Relational, temporal, retrieval and state operators over DataFrames."""
