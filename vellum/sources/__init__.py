"""Readers and writers: documents, markup, ledgers, annotations."""
