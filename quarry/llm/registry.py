"""The queries of this package and their SQL."""

from __future__ import annotations

from .chat import op3_chat_format
from .encoding import OP13_SQL, op13_target_encoding
from .jaccard import op1_jaccard_join
from .media import op9_media
from .mixing import OP5_SQL, op5_mixing
from .packing import op6_packing
from .quality import op2_quality
from .repair import OP11_SQL, op11_structure_repair
from .repeats import op7_repeats
from .token_counts import op4_token_counts
from .token_file import op10_token_file
from .topk import OP8_SQL, op8_top_k
from .transducer import op12_bpe_round_trip

OPERATORS = (op1_jaccard_join, op2_quality, op3_chat_format, op4_token_counts, op5_mixing, op6_packing, op7_repeats, op8_top_k, op9_media, op10_token_file, op11_structure_repair, op12_bpe_round_trip, op13_target_encoding)
QUERIES = {f.__name__: f for f in OPERATORS}
SQL = {"op5_mixing": OP5_SQL, "op8_top_k": OP8_SQL, "op11_structure_repair": OP11_SQL, "op13_target_encoding": OP13_SQL}
