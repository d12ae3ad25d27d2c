"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from verdigraph.llm.chat import OP7_SQL, op7_chat
from verdigraph.llm.clustering import OP13_SQL, op13_clusters
from verdigraph.llm.fingerprint import op6_fingerprint
from verdigraph.llm.langid import op10_langid
from verdigraph.llm.lexical import OP11_SQL, op11_lexical
from verdigraph.llm.licenses import op8_licenses
from verdigraph.llm.mix import OP1_SQL, op1_mix
from verdigraph.llm.near import op2_near
from verdigraph.llm.pieces import op5_pieces
from verdigraph.llm.quality import OP3_SQL, op3_quality
from verdigraph.llm.substrings import op9_substrings
from verdigraph.llm.topk import OP12_SQL, op12_topk
from verdigraph.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_mix": op1_mix,
    "op2_near": op2_near,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_pieces": op5_pieces,
    "op6_fingerprint": op6_fingerprint,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_substrings": op9_substrings,
    "op10_langid": op10_langid,
    "op11_lexical": op11_lexical,
    "op12_topk": op12_topk,
    "op13_clusters": op13_clusters,
}
ORACLE_SQL = {
    "op7_chat": OP7_SQL,
    "op1_mix": OP1_SQL,
    "op3_quality": OP3_SQL,
    "op11_lexical": OP11_SQL,
    "op12_topk": OP12_SQL,
    "op13_clusters": OP13_SQL,
}
