"""lodeweave: code-graph analytics and corpus operators expressed as PySpark DataFrame jobs."""
