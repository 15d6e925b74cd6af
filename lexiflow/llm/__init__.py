"""Operators for preparing training text: repeats, urls, language models, quality, tokens, near copies,
personal data, archives, secrets and benchmark overlap.  Nothing else in the library imports this package."""
