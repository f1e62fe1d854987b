"""quire: document-text analytics as PySpark DataFrame jobs."""
