"""Readers and writers: dirty CSV, result documents, fitted models."""
