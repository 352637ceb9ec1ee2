"""Operators without memory on streaming DataFrames."""

from .rowwise import RowwisePlan, plan_encoding, plan_outlier_bounds, windowed_summary

__all__ = ["RowwisePlan", "plan_encoding", "plan_outlier_bounds", "windowed_summary"]
