"""Operators for preparing training text: filters, scans, classifiers, deduplication, decontamination, encoding."""
