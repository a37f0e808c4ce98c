"""Operations of a training-data pipeline over documents, vectors and pages.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
