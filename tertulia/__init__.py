"""Conversation analytics expressed as Spark DataFrame jobs."""
