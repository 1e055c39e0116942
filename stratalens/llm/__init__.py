"""Training-data operators: token counts, mixing, encoding, toxicity, token files, media, licences, secrets, quality, near-duplicates.

Nothing outside this subpackage imports it.
"""
