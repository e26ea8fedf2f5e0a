"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .language_model import op2_language_model
from .phrases import OP11_SQL, op11_phrases
from .pii import op1_pii
from .quality import op6_quality
from .sentencepiece_codec import op8_sentencepiece
from .simhash import op5_simhash
from .substrings import op7_substrings
from .suffix_index import op10_suffix_index
from .topk import op4_topk
from .toxicity import op13_toxicity
from .trie import OP12_SQL, op12_trie
from .warc import OP9_SQL, op9_warc_audit

QUERIES = {
    "op1_pii": op1_pii,
    "op2_language_model": op2_language_model,
    "op3_decontaminate": op3_decontaminate,
    "op4_topk": op4_topk,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_substrings": op7_substrings,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_warc_audit": op9_warc_audit,
    "op10_suffix_index": op10_suffix_index,
    "op11_phrases": op11_phrases,
    "op12_trie": op12_trie,
    "op13_toxicity": op13_toxicity,
}

ORACLE: dict[str, str] = {
    "op9_warc_audit": OP9_SQL,
    "op11_phrases": OP11_SQL,
    "op12_trie": OP12_SQL,
}
