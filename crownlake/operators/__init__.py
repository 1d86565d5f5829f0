"""Operators on points, rasters, clusters, labels and models: DataFrame in, DataFrame out."""
