"""The queries of this package and their SQL."""

from __future__ import annotations

from . import line_dedup, minhash
from .ann import op2_nearest_neighbours
from .line_dedup import op4_line_dedup
from .lm_scoring import op5_lm_scoring
from .minhash import op10_minhash
from .mixing import op1_mix_sources
from .quality import op7_quality_rules
from .sentencepiece_codec import op6_sentencepiece
from .token_counts import op3_token_counts
from .token_output import op9_token_output
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_nearest_neighbours, op3_token_counts, op4_line_dedup, op5_lm_scoring,
        op6_sentencepiece, op7_quality_rules, op8_toxicity, op9_token_output, op10_minhash,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": line_dedup.ORACLE_SQL, "op10_minhash": minhash.ORACLE_SQL}
