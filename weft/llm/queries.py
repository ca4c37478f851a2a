"""The operators' queries and the SQL that says the same, by name."""

from weft.llm.bytebpe import op13_bpe_round_trip
from weft.llm.editembed import op8_edit_fingerprints
from weft.llm.htmlmain import op6_main_text
from weft.llm.idstore import op5_token_store
from weft.llm.lexical import OP12_SQL, op12_lexical_search
from weft.llm.linededup import op3_line_dedup
from weft.llm.lmscore import op1_lm_scores
from weft.llm.mixing import OP10_SQL, op10_mix_sources
from weft.llm.packing import op7_packing
from weft.llm.repair import OP11_SQL, op11_repair_conversations
from weft.llm.repetition import op9_quality_rules
from weft.llm.simhash import op2_simhash_near_dedup
from weft.llm.viterbi import op4_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scores, op2_simhash_near_dedup, op3_line_dedup, op4_token_counts, op5_token_store,
        op6_main_text, op7_packing, op8_edit_fingerprints, op9_quality_rules, op10_mix_sources,
        op11_repair_conversations, op12_lexical_search, op13_bpe_round_trip,
    )
}

ORACLES = {"op10_mix_sources": OP10_SQL, "op11_repair_conversations": OP11_SQL, "op12_lexical_search": OP12_SQL}
