"""Readers and writers of record tables, id lists and reports."""
