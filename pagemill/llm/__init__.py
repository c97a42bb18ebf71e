"""Training-data operators: toxicity, near-dedup, LM scoring, decontamination and others.

Nothing outside this subpackage imports it.
"""
