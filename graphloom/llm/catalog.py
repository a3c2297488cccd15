"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import hnsw, jaccard, katz, langid, media, mixing, packing, quality, records, spans

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_langid": langid.op2_langid,
    "op3_hnsw": hnsw.op3_hnsw,
    "op4_katz": katz.op4_katz,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_pack": packing.op6_pack,
    "op7_spans": spans.op7_spans,
    "op8_media": media.op8_media,
    "op9_quality": quality.op9_quality,
    "op10_records": records.op10_records,
}
ORACLE_SQL = {"op3_hnsw": hnsw.OP3_SQL, "op5_jaccard": jaccard.OP5_SQL, "op7_spans": spans.OP7_SQL}
