"""Planning-data checks and decisions as Spark DataFrame jobs."""
