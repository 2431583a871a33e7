"""Composed cohort pipelines."""
