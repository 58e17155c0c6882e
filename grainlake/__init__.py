"""Voxel-grain analytics on Spark DataFrames."""
