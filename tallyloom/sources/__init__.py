"""Readers, writers, schemas, and what may be plugged in from outside."""
