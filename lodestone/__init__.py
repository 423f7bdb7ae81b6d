"""Hybrid retrieval, record-store analytics and corpus preparation on PySpark."""
