"""The queries of this folder and their DuckDB counterparts."""

from __future__ import annotations

from .conversation_repair import op13_conversation_repair
from .fingerprints import op10_fingerprints
from .lexical_search import OP11_SQL, op11_lexical_search
from .mixing import op5_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .neighbours import op4_neighbours
from .quality import op2_quality
from .sentencepiece_fst import op3_sentencepiece
from .sharding import op7_sharding
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op8_token_counts
from .token_output import op1_token_output
from .url_filters import op12_url_filters

QUERIES = {f.__name__: f for f in (op1_token_output, op2_quality, op3_sentencepiece, op4_neighbours, op5_mixing, op6_suffix_dedup, op7_sharding, op8_token_counts, op9_near_dedup, op10_fingerprints, op11_lexical_search, op12_url_filters, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op9_near_dedup": OP9_SQL, "op11_lexical_search": OP11_SQL}
