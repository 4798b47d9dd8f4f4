"""Relational operators and NumPy kernels."""
