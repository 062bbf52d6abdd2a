"""The registered queries of this subpackage and the SQL of those that SQL can express. The pipeline registers itself in the entry."""

from . import chat, langid, licenses, mixing, packing, quality, simhash, substring, tokencount, topk

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_language": langid.op2_language,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_simhash": simhash.op6_simhash,
    "op7_substring": substring.op7_substring,
    "op8_mixing": mixing.op8_mixing,
    "op9_tokens": tokencount.op9_tokens,
    "op10_licenses": licenses.op10_licenses,
}

ORACLE_SQL = {
    "op3_topk": topk.OP3_SQL,
    "op7_substring": substring.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
