"""Column helpers and numerical kernels."""
