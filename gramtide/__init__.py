"""Gramtide: analytics of dated text corpora on Spark DataFrames."""
