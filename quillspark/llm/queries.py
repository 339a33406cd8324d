"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP10_SQL, op10_chat_format
from .decontaminate import OP2_SQL, op2_decontaminate
from .line_dedup import OP4_SQL, op4_line_dedup
from .near_dup import OP5_SQL, op5_near_dup
from .quality import op7_quality
from .sentencepiece_fst import op9_sentencepiece
from .token_counts import op6_token_counts
from .token_files import op1_token_files
from .topk_search import OP8_SQL, op8_topk_search
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {f.__name__: f for f in (op1_token_files, op2_decontaminate, op3_url_filter, op4_line_dedup, op5_near_dup, op6_token_counts, op7_quality, op8_topk_search, op9_sentencepiece, op10_chat_format)}
ORACLES = {"op5_near_dup": OP5_SQL, "op8_topk_search": OP8_SQL, "op10_chat_format": OP10_SQL, "op2_decontaminate": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_line_dedup": OP4_SQL}
