"""Training-corpus operators: private data, dedup, quality, toxicity, HTML, mixing, decontamination, chat.

Nothing outside this subpackage imports it.
"""
