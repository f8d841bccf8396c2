"""Operators over DataFrames of lines: merging, splitting, checking, clustering, reporting."""
