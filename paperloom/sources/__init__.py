"""Readers and writers of pages, uploads and corpus tables."""
