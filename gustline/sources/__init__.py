"""Readers for landed files: XML, CSV, text, HTML tables and binary blobs."""
