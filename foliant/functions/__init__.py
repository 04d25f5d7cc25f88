"""Codecs, ciphers and the column functions made of them."""
