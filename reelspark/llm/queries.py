"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op9_nearest
from .chat import OP5_SQL, op5_chat_format
from .decontaminate import op2_decontaminate
from .lm_score import op6_lm_score
from .mixing import OP7_SQL, op7_poisson_mix
from .near_dup import op4_near_duplicates
from .quality import op10_quality
from .resample import OP13_SQL, op13_importance_resample
from .substring_dedup import op3_substring_dedup
from .token_store import op8_token_store
from .token_align import op11_token_align
from .trie_bpe import op12_trie_bpe
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_format": op5_chat_format,
    "op6_lm_score": op6_lm_score,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_token_store": op8_token_store,
    "op9_nearest": op9_nearest,
    "op10_quality": op10_quality,
    "op11_token_align": op11_token_align,
    "op12_trie_bpe": op12_trie_bpe,
    "op13_importance_resample": op13_importance_resample,
}

ORACLE_SQL = {"op1_warc": OP1_SQL, "op5_chat_format": OP5_SQL, "op7_poisson_mix": OP7_SQL, "op13_importance_resample": OP13_SQL}
