"""Training-data operators: token counts, deduplication, extraction, quality, search and mixing.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` live in :mod:`codeframe.llm.queries`.
"""
