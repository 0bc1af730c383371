"""Tessera: analytics and corpus preparation as Spark DataFrame, SQL and streaming plans."""
