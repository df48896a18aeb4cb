"""Reductions over unbounded input."""
