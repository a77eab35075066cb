"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from tidewatch.llm.align import op12_token_alignment
from tidewatch.llm.ann import op5_learned_partitions
from tidewatch.llm.bpe import op10_byte_bpe
from tidewatch.llm.chat_tools import OP1_SQL, op1_tool_call_linking
from tidewatch.llm.decontaminate import OP13_SQL, op13_decontamination
from tidewatch.llm.gbt_quality import op7_histogram_gbt
from tidewatch.llm.minhash import OP3_SQL, op3_fast_similarity_sketching
from tidewatch.llm.mixing import op6_pivotal_mix
from tidewatch.llm.ngram_lm import OP9_SQL, op9_backoff_automaton
from tidewatch.llm.pii import op8_information_sanitiser
from tidewatch.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from tidewatch.llm.sharding import op4_two_pass_shuffle
from tidewatch.llm.weak_supervision import op2_weak_supervision

QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_call_linking, op2_weak_supervision, op3_fast_similarity_sketching, op4_two_pass_shuffle, op5_learned_partitions,
        op6_pivotal_mix, op7_histogram_gbt, op8_information_sanitiser, op9_backoff_automaton, op10_byte_bpe,
        op11_prefix_trie, op12_token_alignment, op13_decontamination,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_tool_call_linking": OP1_SQL, "op3_fast_similarity_sketching": OP3_SQL, "op9_backoff_automaton": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_decontamination": OP13_SQL}
