"""Operators for preparing training text: deduplication, language ID, filters, mixing and tokenised output."""
