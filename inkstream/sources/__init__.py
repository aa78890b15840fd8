"""sources of the document-ingestion engine."""
