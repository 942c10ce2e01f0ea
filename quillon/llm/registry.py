"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillon.llm import sql
from quillon.llm.collocation import op13_collocations
from quillon.llm.edit_sketch import op6_edit_embedding
from quillon.llm.exact import op11_exact_dedup
from quillon.llm.html_text import op3_host_suffix_array
from quillon.llm.jaccard import op4_jaccard_metric_join
from quillon.llm.media import op1_lossless_webp
from quillon.llm.mixing import op5_hierarchical_mixing
from quillon.llm.packing import op2_best_fit_packing
from quillon.llm.pii import op10_pii_anchor_expansion
from quillon.llm.prefix_trie import op12_prefix_trie
from quillon.llm.quality import op9_pu_quality
from quillon.llm.substring import op8_super_kmer_dedup
from quillon.llm.token_count import op7_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lossless_webp,
        op2_best_fit_packing,
        op3_host_suffix_array,
        op4_jaccard_metric_join,
        op5_hierarchical_mixing,
        op6_edit_embedding,
        op7_token_counts,
        op8_super_kmer_dedup,
        op9_pu_quality,
        op10_pii_anchor_expansion,
        op11_exact_dedup,
        op12_prefix_trie,
        op13_collocations,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = dict(sql.SQL)
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
