"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .chat import OP2_SQL, op2_chat_formatting
from .codes import OP11_SQL, op11_vector_codes
from .langid import op1_language_id
from .lines import op4_line_dedup
from .packing import op6_packing
from .quality import op10_quality_classifier
from .simhash import op8_simhash_dedup
from .spelling import OP12_SQL, op12_spelling_variants
from .tokenfiles import op13_token_files
from .topk import OP9_SQL, op9_exact_topk
from .urls import OP5_SQL, op5_url_filter
from .vectors import OP3_SQL, op3_embedding_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}

ORACLES = {"op2_chat_formatting": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op5_url_filter": OP5_SQL, "op9_exact_topk": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling_variants": OP12_SQL}
