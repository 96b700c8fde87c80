"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import ORACLE as OP4
from .decontaminate import op4_decontaminate
from .langid import op8_language_id
from .licenses import ORACLE as OP10
from .licenses import op10_license_scan
from .lm import op5_lm_scoring
from .media import op2_media_columns
from .mixing import ORACLE as OP1
from .mixing import op1_mix_sources
from .packing import op12_best_fit_packing
from .phrases import ORACLE as OP13
from .phrases import op13_phrase_collocations
from .pii import op6_pii_surrogates
from .simhash import op7_simhash_near_dedup
from .substring import ORACLE as OP3
from .substring import op3_substring_dedup
from .suffix_dedup import ORACLE as OP9
from .suffix_dedup import op9_suffix_dedup
from .trie import ORACLE as OP11
from .trie import op11_conversation_trie


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_media_columns, op3_substring_dedup, op4_decontaminate, op5_lm_scoring, op6_pii_surrogates, op7_simhash_near_dedup, op8_language_id, op9_suffix_dedup, op10_license_scan, op11_conversation_trie, op12_best_fit_packing, op13_phrase_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op9_suffix_dedup": OP9, "op3_substring_dedup": OP3, "op4_decontaminate": OP4, "op10_license_scan": OP10, "op11_conversation_trie": OP11, "op13_phrase_collocations": OP13}
