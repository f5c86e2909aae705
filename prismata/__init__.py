"""prismata: faceted catalogue analytics as PySpark DataFrame jobs."""
