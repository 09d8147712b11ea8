"""Content-site analytics, moderation and corpus preparation as Spark DataFrame jobs."""
