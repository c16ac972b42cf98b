"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from shelfmark.llm.audit import OP12_SQL, op12_filter_audit
from shelfmark.llm.common import shipped
from shelfmark.llm.decontaminate import OP10_SQL, op10_decontaminate
from shelfmark.llm.exact import OP8_SQL, op8_exact_dedup
from shelfmark.llm.jaccard import op3_jaccard
from shelfmark.llm.likelihood import op4_lattice
from shelfmark.llm.lines import op7_line_dedup
from shelfmark.llm.packing import op5_packing
from shelfmark.llm.pii import op13_personal_data
from shelfmark.llm.quality import op9_quality
from shelfmark.llm.resampling import OP11_SQL, op11_resampling
from shelfmark.llm.sharding import op6_sharding, op6_sql
from shelfmark.llm.suffixes import op2_suffix_dedup
from shelfmark.llm.urls import OP1_SQL, op1_url_rules

QUERIES = {
    "op1_url_rules": shipped(op1_url_rules),
    "op2_suffix_dedup": shipped(op2_suffix_dedup),
    "op3_jaccard": shipped(op3_jaccard),
    "op4_lattice": shipped(op4_lattice),
    "op5_packing": shipped(op5_packing),
    "op6_sharding": op6_sharding,
    "op7_line_dedup": shipped(op7_line_dedup),
    "op8_exact_dedup": shipped(op8_exact_dedup),
    "op9_quality": shipped(op9_quality),
    "op10_decontaminate": shipped(op10_decontaminate),
    "op11_resampling": shipped(op11_resampling),
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}

ORACLES = {
    "op1_url_rules": OP1_SQL,
    "op6_sharding": op6_sql(),
    "op8_exact_dedup": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_resampling": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
