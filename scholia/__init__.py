"""Learning analytics and corpus preparation on Spark."""
