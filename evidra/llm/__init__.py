"""Training-data operators: media, token stores, near-duplicates, classifiers, language models and mixing.

Nothing outside this subpackage imports it; the queries and their SQL are in ``evidra.llm.queries``.
"""
