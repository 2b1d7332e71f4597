"""Cohort time-series preparation, statistics and evaluation as Spark DataFrame jobs."""
