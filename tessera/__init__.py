"""tessera: corpus preparation and multi-vector search on Spark."""
