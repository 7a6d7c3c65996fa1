"""Readers and writers of tables, documents and result pages."""
