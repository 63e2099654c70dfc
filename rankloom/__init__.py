"""Retrieval-evaluation analytics as DataFrame operators.

Subpackages: ``sources`` (scans and loaders), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame), ``plans`` (named queries and their SQL
oracles), ``streaming`` (event replay) and ``llm`` (training-data operators; nothing
else imports it).
"""
