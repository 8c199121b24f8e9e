"""Readers that turn landed files and tables into cues, sections and passages."""
