"""Operators for building training corpora: scans, classifiers, deduplication, mixing."""
