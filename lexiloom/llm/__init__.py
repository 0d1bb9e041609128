"""Training-data operators: mixing, extraction, dedup, tokens, archives, quality, privacy, toxicity, chat, search.

Nothing outside this subpackage imports it.
"""
