"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from quizloom.llm import (
    best_fit, chat_format, decontaminate, filter_audit, language_id, license_scan, page_text, sentence_pieces,
    simhash_dedup, source_audit, substring_dedup, vector_dedup, warc_convert)
from quizloom.session import configure


def _query(fn):
    def run(spark, sf_dir):
        configure(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


_OPS = [
    (vector_dedup.op1_embedding_dedup, None),
    (license_scan.op2_license_scan, None),
    (sentence_pieces.op3_sentencepiece, None),
    (substring_dedup.op4_substring_dedup, substring_dedup.OP4_SQL),
    (language_id.op5_language_id, None),
    (simhash_dedup.op6_simhash_dedup, None),
    (warc_convert.op7_warc_convert, warc_convert.OP7_SQL),
    (chat_format.op8_chat_format, chat_format.OP8_SQL),
    (decontaminate.op9_benchmark_decontamination, decontaminate.OP9_SQL),
    (page_text.op10_html_text, None),
    (source_audit.op11_source_divergence, source_audit.OP11_SQL),
    (filter_audit.op12_filter_interaction, filter_audit.OP12_SQL),
    (best_fit.op13_best_fit_packing, None),
]

QUERIES = {fn.__name__: _query(fn) for fn, _ in _OPS}
ORACLE_SQL = {fn.__name__: sql for fn, sql in _OPS if sql}
