"""Training-data operators: quality, dedup, PII, toxicity, licences, mixing, decontamination, URLs.

Nothing outside this subpackage imports it; its queries live in ``llm.queries``.
"""
