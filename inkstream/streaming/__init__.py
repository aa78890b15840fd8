"""streaming of the document-ingestion engine."""
