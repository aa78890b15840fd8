"""operators of the document-ingestion engine."""
