"""The catalogue's operators; importing this package registers them all."""

from . import association, classify, cluster, describe, models, prep, timeseries

__all__ = ["association", "classify", "cluster", "describe", "models", "prep", "timeseries"]
