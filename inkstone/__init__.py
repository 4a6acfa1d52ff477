"""Document retrieval, grounding and corpus preparation as Spark jobs."""
