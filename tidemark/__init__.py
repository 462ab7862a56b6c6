"""Spark jobs for financial-crime monitoring over whole ledgers and streams."""
