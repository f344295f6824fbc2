"""Readers of document files: each gives rows with a status, and never fails a job for one file."""
