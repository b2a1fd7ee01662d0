"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op13_source_divergence
from .fingerprints import op1_imatch
from .lm import op5_kneser_ney
from .manifest import SQL as MANIFEST_SQL
from .manifest import op12_merkle_manifest
from .mixing import op6_pivotal_mixing
from .near_dedup import op4_bag_minhash
from .packing import op2_pattern_packing
from .paragraph_dedup import op10_paragraph_minhash
from .quality import op8_perplexity_bands
from .suffix_dedup import op9_column_wise_dedup
from .token_counts import op7_token_counts
from .toxicity import op3_recurrent_toxicity
from .vector_dedup import op11_cross_polytope

QUERIES = {
    q.__name__: q
    for q in (
        op1_imatch, op2_pattern_packing, op3_recurrent_toxicity, op4_bag_minhash, op5_kneser_ney,
        op6_pivotal_mixing, op7_token_counts, op8_perplexity_bands, op9_column_wise_dedup, op10_paragraph_minhash, op11_cross_polytope, op12_merkle_manifest,
        op13_source_divergence,
    )
}
#: The first ten and operator 11 can't be written in SQL: they train models, draw by hashes, or compare bytes,
#: shingles and hashed vectors. The tests
#: hold them against plain versions: 1 (fingerprints, likeness), 2 (ids, places), 4 and 10 (classes), 5 and 8 (probabilities,
#: bands), 6 (targets), 7 (counts of every prefix), 9 (removed bytes); 3 by accuracy and by scoring every window alone.
SQL: dict[str, str] = {**MANIFEST_SQL, **DIVERGENCE_SQL}
