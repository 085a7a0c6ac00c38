"""Scalar functions: the reference signal, checksums, positions and formatting."""
