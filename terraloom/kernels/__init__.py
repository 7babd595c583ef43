"""Kernels over one mesh, tile or file: what no Column expression can state."""
