"""Millrace: evidence retrieval and text processing as DataFrame plans."""
