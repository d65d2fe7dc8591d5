"""Operators of a training-data pipeline: search, language, toxicity, HTML,
decontamination, language models, quality, token files, pieces, near-duplicates,
fill-in-the-middle, resampling, fingerprints.

Nothing outside this subpackage imports it.
"""
