"""Operators for preparing training text: formatting, filtering, deduplication,
decontamination, redaction, extraction and tokenisation of documents.

Nothing outside this subpackage imports it.
"""
