"""Operators over DataFrames: pairs, alignments, metrics, encoders, design."""
