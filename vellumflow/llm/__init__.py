"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; it may be deleted together with
``tests/llm`` and ``corpus_pipeline.py``.
"""
