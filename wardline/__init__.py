"""Text moderation and corpus preparation on Spark."""
