"""The op queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from nearfield.llm.bloom_lookup import op9_fingerprints
from nearfield.llm.fertility import op5_fertility
from nearfield.llm.line_align import op4_line_dedup
from nearfield.llm.minhash_paths import op3_minhash_near_dedup
from nearfield.llm.mixing import OP1_SQL, op1_mixing
from nearfield.llm.pieces import op8_sentencepiece
from nearfield.llm.quality import op7_quality
from nearfield.llm.toxicity import op2_toxicity
from nearfield.llm.url_rules import OP6_SQL, op6_url_rules
from nearfield.llm.zstd_language import op10_language_id

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_fertility": op5_fertility,
    "op6_url_rules": op6_url_rules,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_id": op10_language_id,
}
#: op3 and op9 could be written in SQL, but the first is quadratic there and the second's sketch hashes are
#: Spark's own; both are tested against brute force instead.
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op6_url_rules": OP6_SQL}
