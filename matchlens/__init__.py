"""Matchup analytics for NFL, NBA and MLB data on PySpark DataFrames."""
