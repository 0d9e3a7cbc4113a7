"""The queries of this package and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, jaccard, langid, neardup_vectors, packing, pii, quality, shards, topk, toxicity

    found = (
        quality.op1_quality_knn, packing.op2_packing_drr, jaccard.op3_signature_tree, topk.op4_pivot_topk, pii.op5_bootstrap_pii, bpe.op6_trie_bpe, langid.op7_language_crossparse,
        shards.op8_virtual_slots, toxicity.op9_toxicity_fm, neardup_vectors.op10_pq_neardup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    from . import topk

    return {"op4_pivot_topk": topk.OP4_SQL}
