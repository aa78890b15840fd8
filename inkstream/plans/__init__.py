"""plans of the document-ingestion engine."""
