"""emberlog: log-incident analytics expressed as PySpark DataFrame pipelines."""
