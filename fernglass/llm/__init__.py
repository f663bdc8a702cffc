"""Operators for preparing language-model training data.

The rest of the library never imports this subpackage; deleting it (together
with ``corpus_pipeline.py`` and ``tests/llm``) leaves everything else working.
"""
