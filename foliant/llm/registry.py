"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .conversations import OP11_SQL, op11_conversation_repair
from .lattice import op6_lattice_dedup
from .mixing import OP4_SQL, op4_source_mixing
from .packing import op9_bestfit_packing
from .pii import op10_contextual_pii
from .resampling import OP13_SQL, op13_importance_resampling
from .scoring import op1_lm_scoring
from .simhash import op3_simhash_dedup
from .substring import op2_substring_dedup
from .topk import OP5_SQL, op5_exact_topk
from .toxicity import op8_toxicity_chain
from .urls import OP12_SQL, op12_url_filter
from .wrappers import op7_html_extraction

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_substring_dedup, op3_simhash_dedup, op4_source_mixing, op5_exact_topk,
        op6_lattice_dedup, op7_html_extraction, op8_toxicity_chain, op9_bestfit_packing, op10_contextual_pii,
        op11_conversation_repair, op12_url_filter, op13_importance_resampling,
    )
}
ORACLES: dict[str, str] = {
    "op4_source_mixing": OP4_SQL, "op5_exact_topk": OP5_SQL, "op11_conversation_repair": OP11_SQL, "op12_url_filter": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
