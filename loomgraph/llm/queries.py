"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op5_byte_bpe
from .conversations import OP13_SQL, op13_conversation_repair
from .embedding_dedup import OP2_SQL, op2_embedding_near_dedup
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .license_scan import op8_license_scan
from .minhash import op1_minhash_near_dedup
from .packing import op9_best_fit_packing
from .phrase_fingerprint import op12_phrase_fingerprint
from .quality import op4_quality_classifier
from .secret_scan import op10_secret_scan
from .url_filter import OP3_SQL, op3_url_filter
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_phrase_fingerprint": op12_phrase_fingerprint,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
