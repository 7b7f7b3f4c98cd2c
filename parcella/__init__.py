"""Spatial scene partitioning and training-data preparation as Spark plans."""
