"""Readers and writers of corpora, gold cases and index exports."""
