"""The queries opN_<name> of this subpackage and the SQL that checks them."""

from __future__ import annotations

from verdigris.llm.decontam import OP9_SQL, op9_decontamination
from verdigris.llm.kd_shards import op4_kd_shards
from verdigris.llm.licenses import op10_license_scan
from verdigris.llm.near_dedup import OP3_SQL, op3_near_duplicates
from verdigris.llm.order_minhash import op6_order_minhash
from verdigris.llm.packing import op8_best_fit_packing
from verdigris.llm.pitman_yor import op2_pitman_yor
from verdigris.llm.token_counts import op1_token_counts
from verdigris.llm.toxicity import op5_toxicity
from verdigris.llm.url_trie import OP7_SQL, op7_url_trie

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_kd_shards": op4_kd_shards,
    "op5_toxicity": op5_toxicity,
    "op6_order_minhash": op6_order_minhash,
    "op7_url_trie": op7_url_trie,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": OP3_SQL, "op7_url_trie": OP7_SQL, "op9_decontamination": OP9_SQL}
