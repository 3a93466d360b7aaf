"""Tidemill: postings analytics on Spark DataFrames."""
