"""Operators from table to table: validation, resolution, segmentation, scoring, views."""
