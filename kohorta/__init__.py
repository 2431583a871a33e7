"""Longitudinal cohort analytics expressed as Spark DataFrame plans."""
