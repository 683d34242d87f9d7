"""lumenframe: Spark-native analytics over geolocated, timestamped observations and text corpora."""
