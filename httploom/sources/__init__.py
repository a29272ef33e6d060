"""Readers that normalise captures and source trees into DataFrames."""
