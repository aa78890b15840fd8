"""Inkstream: a PySpark engine that turns web pages, JSON documents and extracted
PDF text into clean, deduplicated, retrieval-ready records."""
