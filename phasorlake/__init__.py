"""Directional, subspace and phase-coherence analytics on Spark DataFrames."""
