"""Media-catalogue analytics on Spark."""
