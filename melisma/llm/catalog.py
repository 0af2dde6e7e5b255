"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import clustering, fingerprints, jaccard, langid, licenses, lm, mixing, neighbours, packing, search, secrets, sharding, trie

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op5_lm_scores": lm.op5_lm_scores,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op6_packing": packing.op6_packing,
    "op1_language_id": langid.op1_language_id,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op2_sharding": sharding.op2_sharding,
    "op4_license_scan": licenses.op4_license_scan,
    "op7_topk_search": search.op7_topk_search,
    "op9_mixing": mixing.op9_mixing,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_centroids": clustering.op13_centroids,
}
ORACLES = {"op8_jaccard_join": jaccard.ORACLE, "op7_topk_search": search.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_centroids": clustering.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
