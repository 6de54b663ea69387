"""Annotated-text audit, splitting and evaluation on Spark."""
