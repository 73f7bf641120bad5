"""Relational operators of the engine: DataFrames in, one lazy DataFrame out."""
