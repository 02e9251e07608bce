"""Training-data operators: dedup, quality, licences, tokenisation, mixing, sharding, language-model scores.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
