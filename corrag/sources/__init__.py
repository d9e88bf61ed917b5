"""Readers and writers: pages, feeds, evaluation sets, the chunk store, reports."""
