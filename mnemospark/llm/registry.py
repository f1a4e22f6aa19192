"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from .clustering import OP11_SQL, op11_clustering
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_text import op3_html_text
from .lang_id import op2_language_id
from .licenses import op5_licenses
from .line_dedup import OP12_SQL, op12_line_dedup
from .mixing import op9_mixing
from .packing import op4_packing
from .sharding import op1_sharding
from .simhash import op10_simhash
from .topk import OP8_SQL, op8_topk
from .toxicity import op6_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_clustering": op11_clustering,
    "op12_line_dedup": op12_line_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op7_exact_dedup": OP7_SQL,
    "op8_topk": OP8_SQL,
    "op11_clustering": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
