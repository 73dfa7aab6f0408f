"""docweave: document analytics and retrieval as Spark jobs."""
