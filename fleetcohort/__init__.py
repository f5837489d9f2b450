"""Driver cohort analytics as PySpark DataFrame and Spark ML jobs."""
