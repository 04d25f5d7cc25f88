"""Training-data operators: media, chat, near-duplicates, token files, PII,
BPE, mixing, language and quality models.

Nothing outside this subpackage imports it.
"""
