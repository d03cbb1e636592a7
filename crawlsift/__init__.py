"""Endpoint and secret findings over large web crawls, as Spark DataFrame jobs."""
