"""The queries of this subpackage and their SQL; a query without SQL is tested against brute force."""

from __future__ import annotations

from .decontam import OP9_SQL, op9_decontamination
from .licenses import OP5_SQL, op5_license_scan
from .lines import op1_line_dedup
from .lm import op7_lm_scoring
from .mixing import op6_mixing
from .search import OP4_SQL, op4_topk_search
from .sharding import op3_sharding
from .simhash import op10_simhash
from .tokens import op8_token_binary
from .toxicity import op2_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_topk_search": op4_topk_search,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_binary": op8_token_binary,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
}

SQL: dict[str, str] = {"op4_topk_search": OP4_SQL, "op5_license_scan": OP5_SQL, "op9_decontamination": OP9_SQL}
