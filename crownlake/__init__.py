"""crownlake: a Spark-native engine for point clouds, rasters, crowns and their classifiers."""
