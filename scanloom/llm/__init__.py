"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage; it can be removed together with
``corpus_pipeline.py`` and ``tests/llm`` and the rest goes on working.
"""
