"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this subpackage imports it.  Queries over the shared test
tables live in :mod:`linkrisk.llm.queries`.
"""
