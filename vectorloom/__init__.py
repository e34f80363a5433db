"""A Spark-native engine for georeferenced vector-map data."""
