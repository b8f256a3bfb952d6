"""Readers and writers: documents, tables by convention, run folders, exports."""
