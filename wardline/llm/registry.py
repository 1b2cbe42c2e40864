"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import fingerprint, jaccard, mixing, pieces, pii, quality, sharding, substring, vectors, warc


def queries():
    return {
        "op1_pieces_suffix_array": pieces.op1_pieces_suffix_array,
        "op2_multiset_fingerprint": fingerprint.op2_multiset_fingerprint,
        "op3_pii_skip_chain": pii.op3_pii_skip_chain,
        "op4_shard_label_propagation": sharding.op4_shard_label_propagation,
        "op5_quality_subword": quality.op5_quality_subword,
        "op6_vectors_grid_order": vectors.op6_vectors_grid_order,
        "op7_mix_sainte_lague": mixing.op7_mix_sainte_lague,
        "op8_substring_suffix_array": substring.op8_substring_suffix_array,
        "op9_jaccard_bayes": jaccard.op9_jaccard_bayes,
        "op10_warc_boundary_chain": warc.op10_warc_boundary_chain,
    }


def oracle_sql():
    return {
        "op2_multiset_fingerprint": fingerprint.OP2_SQL,
        "op6_vectors_grid_order": vectors.OP6_SQL,
        "op7_mix_sainte_lague": mixing.OP7_SQL,
        "op8_substring_suffix_array": substring.OP8_SQL,
        "op9_jaccard_bayes": jaccard.OP9_SQL,
        "op10_warc_boundary_chain": warc.OP10_SQL,
    }
