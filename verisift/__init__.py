"""Statement checking and text-corpus preparation as Spark DataFrame jobs."""
