"""Operators on stores, trees of elements and chunk grids: DataFrames in, DataFrames out."""
