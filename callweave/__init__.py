"""Conversation analytics and corpus preparation on PySpark."""
