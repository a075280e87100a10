"""Spark-native building of map datasets and terrain grids from map extracts, elevation and points."""
