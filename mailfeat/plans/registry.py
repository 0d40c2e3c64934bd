"""Binds driver query names to operator plans and their oracle SQL."""

from __future__ import annotations

from . import header_queries, learn_queries, metric_queries, report_queries, stream_queries, text_queries

QUERIES = {}
ORACLE = {}
for mod in (text_queries, metric_queries, header_queries, learn_queries, report_queries, stream_queries):
    QUERIES.update(mod.QUERIES)
    ORACLE.update(mod.ORACLE)


def flagship(spark, sf_dir):
    return text_queries.q_discriminative_vocab(spark, sf_dir)
