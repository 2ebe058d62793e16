"""Readers of structures, sequences, pair lists, arrays, weights and caches."""
