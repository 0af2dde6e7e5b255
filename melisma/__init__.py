"""Melisma: ordered-event analytics on Spark DataFrames."""
