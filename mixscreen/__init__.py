"""Mixture screening and prioritisation as Spark jobs."""
