"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .codes import OP11_SQL, op11_codes
from .fingerprint import op2_fingerprint
from .language import op13_language
from .mixing import OP4_SQL, op4_mixing
from .ngram import op6_language_model
from .packing import op5_packing
from .quality import op9_quality
from .simhash import op3_simhash
from .spans import op8_spans
from .token_counts import op10_token_counts
from .topk import OP1_SQL, op1_topk
from .toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_topk": op1_topk,
        "op2_fingerprint": op2_fingerprint,
        "op3_simhash": op3_simhash,
        "op4_mixing": op4_mixing,
        "op5_packing": op5_packing,
        "op6_language_model": op6_language_model,
        "op7_toxicity": op7_toxicity,
        "op8_spans": op8_spans,
        "op9_quality": op9_quality,
        "op10_token_counts": op10_token_counts,
        "op11_codes": op11_codes,
        "op12_alignment": op12_alignment,
        "op13_language": op13_language,
    }


def oracle_sql() -> dict[str, str]:
    """Gamma samples (2), majority hashes (3), packing (5), models (6, 7, 9, 13), span hashes (8) and tokens (10, 12) have no SQL form; tests hold them
    against brute force or held-out labels."""
    return {"op1_topk": OP1_SQL, "op4_mixing": OP4_SQL, "op11_codes": OP11_SQL}
