"""Training-data operators over tables of documents, pages and vectors.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` chains some of its operators.
"""
