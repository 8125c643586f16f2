"""Matrices, vectors, scalars and reductions."""
