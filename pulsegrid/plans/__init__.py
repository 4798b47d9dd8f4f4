"""Whole batch plans."""
