"""The numbered queries and their SQL."""

from __future__ import annotations

from tallyfield.llm import centroids, chat, crf, gif, minhash, mixing, nnls, packing, pii, pivots, spelling, suffixes, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_topk": pivots.op2_topk,
    "op3_gif": gif.op3_gif,
    "op4_pack": packing.op4_pack,
    "op5_quality": crf.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_warc": warc.op7_warc,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_minhash": minhash.op9_minhash,
    "op10_chat": chat.op10_chat,
    "op11_centroids": centroids.op11_centroids,
    "op12_windows": nnls.op12_windows,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op1_mix": mixing.OP1_SQL,
    "op2_topk": pivots.OP2_SQL,
    "op7_warc": warc.OP7_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
