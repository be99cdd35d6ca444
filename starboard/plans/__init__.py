"""Whole jobs, from sources to written results."""
