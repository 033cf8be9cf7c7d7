"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from fieldledger.llm.chat import ORACLE_OP7, op7_chat_format
from fieldledger.llm.idstore import op1_id_store
from fieldledger.llm.language import op5_language_id
from fieldledger.llm.mixing import op8_mixing
from fieldledger.llm.ngramjoin import ORACLE_OP6, op6_ngram_join
from fieldledger.llm.packing import op3_best_fit_packing
from fieldledger.llm.quality import ORACLE_OP2, op2_quality_rules
from fieldledger.llm.tokencount import op9_token_counts
from fieldledger.llm.topk import ORACLE_OP4, op4_top_k
from fieldledger.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_id_store": op1_id_store,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_top_k": op4_top_k,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_chat_format": op7_chat_format,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": ORACLE_OP2,
    "op4_top_k": ORACLE_OP4,
    "op6_ngram_join": ORACLE_OP6,
    "op7_chat_format": ORACLE_OP7,
}
