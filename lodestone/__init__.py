"""lodestone: retrieval and text analytics for short documents, as Spark jobs."""
