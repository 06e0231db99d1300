"""trialflow: benchmark-campaign analytics as Spark DataFrame jobs."""
