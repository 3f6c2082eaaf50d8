"""fathomline: document retrieval analytics as ordinary Spark DataFrame jobs."""
