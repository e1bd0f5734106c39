"""Operators for building training corpora from document, vector and page tables."""
