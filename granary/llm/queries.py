"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from granary.llm.decontaminate import OP4_SQL, op4_decontaminate
from granary.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from granary.llm.hmm_score import op8_hmm_score
from granary.llm.html_extract import op9_html_extract
from granary.llm.language_id import op1_language_id
from granary.llm.mixing import op7_mix_sources
from granary.llm.near_dedup import OP3_SQL, op3_minhash_near_dedup
from granary.llm.quality import op10_quality
from granary.llm.suffix_dedup import OP5_SQL, op5_suffix_dedup
from granary.llm.token_counts import op6_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mix_sources": op7_mix_sources,
    "op8_hmm_score": op8_hmm_score,
    "op9_html_extract": op9_html_extract,
    "op10_quality": op10_quality,
}
ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_suffix_dedup": OP5_SQL,
}
