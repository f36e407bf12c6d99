"""The numbered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from chatlake.llm.bpe import op10_bpe
from chatlake.llm.chat_template import OP1_SQL, op1_chat_format
from chatlake.llm.fill_middle import OP11_SQL, op11_fill_middle
from chatlake.llm.host_graph import op9_host_graph
from chatlake.llm.lexical_search import OP12_SQL, op12_lexical_search
from chatlake.llm.license_scan import op4_license_scan
from chatlake.llm.minhash import op2_minhash
from chatlake.llm.mixture import op8_mixture
from chatlake.llm.neural_lm import op5_neural_lm
from chatlake.llm.quality import op7_quality
from chatlake.llm.token_counts import op13_token_counts
from chatlake.llm.token_orc import op6_token_orc
from chatlake.llm.transport_stream import op3_transport_stream

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_minhash": op2_minhash,
    "op3_transport_stream": op3_transport_stream,
    "op4_license_scan": op4_license_scan,
    "op5_neural_lm": op5_neural_lm,
    "op6_token_orc": op6_token_orc,
    "op7_quality": op7_quality,
    "op8_mixture": op8_mixture,
    "op9_host_graph": op9_host_graph,
    "op10_bpe": op10_bpe,
    "op11_fill_middle": op11_fill_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
}
