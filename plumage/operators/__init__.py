"""Operators on DataFrames of frames, candidates, names, boxes and answers."""
