"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from cairn.llm import centroid_clustering, embedding_dedup, minhash_dedup, mixing, topk_search
from cairn.llm.centroid_clustering import op13_centroid_clustering
from cairn.llm.decontamination import op6_decontamination
from cairn.llm.embedding_dedup import op8_embedding_dedup
from cairn.llm.html_extraction import op9_html_extraction
from cairn.llm.language_id import op7_language_id
from cairn.llm.minhash_dedup import op3_minhash_dedup
from cairn.llm.mixing import op4_mixing
from cairn.llm.pii import op10_pii
from cairn.llm.quality import op2_quality
from cairn.llm.token_alignment import op11_token_alignment
from cairn.llm.token_counts import op1_token_counts
from cairn.llm.topk_search import op12_topk_search
from cairn.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality, op3_minhash_dedup, op4_mixing, op5_toxicity,
        op6_decontamination, op7_language_id, op8_embedding_dedup, op9_html_extraction, op10_pii,
        op11_token_alignment, op12_topk_search, op13_centroid_clustering,
    )
}
ORACLES = {
    "op3_minhash_dedup": minhash_dedup.ORACLE, "op4_mixing": mixing.ORACLE, "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op12_topk_search": topk_search.ORACLE, "op13_centroid_clustering": centroid_clustering.ORACLE,
}
