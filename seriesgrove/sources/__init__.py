"""Readers and writers of series and indexes."""
