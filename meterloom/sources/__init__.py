"""Readers and writers: CSV tables, alert store, metrics and models."""
