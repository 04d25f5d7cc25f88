"""All queries of this subpackage, and their SQL where SQL can express them."""

from . import op1, op10, op2, op3, op4, op5, op6, op7, op8, op9

QUERIES = {
    "op1_tiff": op1.op1_tiff,
    "op2_chat": op2.op2_chat,
    "op3_sorted_projections": op3.op3_sorted_projections,
    "op4_simple8b": op4.op4_simple8b,
    "op5_order_minhash": op5.op5_order_minhash,
    "op6_pseudonyms": op6.op6_pseudonyms,
    "op7_bpe": op7.op7_bpe,
    "op8_mix": op8.op8_mix,
    "op9_langid": op9.op9_langid,
    "op10_crf": op10.op10_crf,
}
ORACLE_SQL = {"op2_chat": op2.SQL, "op3_sorted_projections": op3.SQL}
