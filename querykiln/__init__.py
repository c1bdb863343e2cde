"""Spark jobs for text-to-SQL dataset curation, evaluation and the e-commerce metric layer."""
