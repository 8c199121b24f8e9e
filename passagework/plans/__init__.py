"""Whole jobs: search, ingest, migration."""
