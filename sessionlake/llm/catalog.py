"""The corpus queries, one for each operator, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from sessionlake.llm.chat import OP5_SQL, op5_schema_fingerprint_chat
from sessionlake.llm.decontamination import op1_benchmark_decontamination
from sessionlake.llm.near_dup import OP8_SQL, op8_minhash_near_dedup
from sessionlake.llm.ngram_join import OP11_SQL, op11_count_vector_rtree
from sessionlake.llm.packing import op9_best_fit_packing
from sessionlake.llm.periodic_runs import op13_periodic_runs
from sessionlake.llm.pii import op6_feistel_pseudonyms
from sessionlake.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from sessionlake.llm.quality import op7_ftrl_quality
from sessionlake.llm.topk import OP4_SQL, op4_impact_ordered_topk
from sessionlake.llm.toxicity import op10_toxicity_lexicon
from sessionlake.llm.url_filter import OP2_SQL, op2_host_reputation
from sessionlake.llm.warc import OP3_SQL, op3_warc_normaliser

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_host_reputation,
        op3_warc_normaliser,
        op4_impact_ordered_topk,
        op5_schema_fingerprint_chat,
        op6_feistel_pseudonyms,
        op7_ftrl_quality,
        op8_minhash_near_dedup,
        op9_best_fit_packing,
        op10_toxicity_lexicon,
        op11_count_vector_rtree,
        op12_prefix_trie,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op2_host_reputation": OP2_SQL,
    "op3_warc_normaliser": OP3_SQL,
    "op4_impact_ordered_topk": OP4_SQL,
    "op5_schema_fingerprint_chat": OP5_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op11_count_vector_rtree": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
