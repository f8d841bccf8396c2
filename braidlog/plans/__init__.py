"""Whole jobs: merge days, split a merged log, report templates."""
