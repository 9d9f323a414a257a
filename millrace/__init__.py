"""millrace: document structuring, enrichment and corpus jobs as PySpark DataFrame operators."""
