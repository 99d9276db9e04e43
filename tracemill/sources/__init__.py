"""Readers, reference tables and sinks."""
