"""functions of the document-ingestion engine."""
