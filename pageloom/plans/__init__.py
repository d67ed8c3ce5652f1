"""Whole jobs: lazy plans from tables to tables."""
