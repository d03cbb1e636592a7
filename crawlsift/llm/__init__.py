"""Operators for large text corpora, each by a named method; see the README."""
