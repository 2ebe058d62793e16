"""Kernels in numpy, column expressions, and SQL functions over both."""
