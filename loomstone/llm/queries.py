"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .html import op1_html
from .licenses import op4_licenses
from .mixing import OP5_SQL, op5_mix
from .packing import op9_packing
from .prints import op6_prints
from .quality import op8_quality
from .rules import op2_rules
from .simhash import op7_simhash
from .suffixes import op3_suffixes
from .toxicity import op10_toxicity

QUERIES = {
    "op1_html": op1_html,
    "op2_rules": op2_rules,
    "op3_suffixes": op3_suffixes,
    "op4_licenses": op4_licenses,
    "op5_mix": op5_mix,
    "op6_prints": op6_prints,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

SQL = {
    "op5_mix": OP5_SQL,
}
