"""Shared plan pieces: operator registry, fused validation, order, rank, grid and moment cores."""
