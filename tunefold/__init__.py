"""Playlist, vector and corpus analytics on Spark DataFrames."""
