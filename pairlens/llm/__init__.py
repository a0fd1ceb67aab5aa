"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each operator has a general
interface of its own; the thin ``opN_*`` queries are collected in
``pairlens.llm.registry``.
"""
