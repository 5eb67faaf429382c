"""Corpus preparation and scoring for sequence models, written as Spark DataFrame jobs."""
