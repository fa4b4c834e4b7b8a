"""Operators for preparing training data: near copies, quality, tokens, URLs, secrets, toxicity, licences, leaks, language models."""
