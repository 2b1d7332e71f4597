"""Pipelines that chain operators into whole jobs."""
