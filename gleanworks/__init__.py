"""Dialogue-data curation, evaluation and metering on Spark DataFrames."""
