"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroid_clustering
from .decontamination import op5_benchmark_decontamination
from .fingerprints import op3_document_fingerprints
from .language_id import op8_language_id
from .ngram_join import op6_ngram_jaccard_join
from .negatives import OP13_SQL, op13_hard_negatives
from .pii import op12_pii
from .quality_lm import op7_quality_classifier
from .sampling import op10_sentencepiece_sampling
from .secrets import op2_secret_scans
from .suffix_dedup import op9_suffix_array_dedup
from .token_counts import op1_token_counts
from .warc import OP4_SQL, op4_warc


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_secret_scans": op2_secret_scans,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op4_warc": op4_warc,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_language_id": op8_language_id,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_sentencepiece_sampling": op10_sentencepiece_sampling,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_pii": op12_pii,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op11_centroid_clustering": OP11_SQL, "op13_hard_negatives": OP13_SQL}
