"""Registered queries of this subpackage, with SQL where SQL can say them."""

from __future__ import annotations

from tracelake.llm import twins
from tracelake.llm.chat_format import op6_chat_format
from tracelake.llm.decontaminate import op9_decontaminate
from tracelake.llm.filtering_lloyd import op11_vector_codes
from tracelake.llm.gru_lm import op5_gru_lm
from tracelake.llm.hilbert_ann import op7_hilbert_neighbours
from tracelake.llm.html_text import op4_html_text
from tracelake.llm.licenses import op3_licenses
from tracelake.llm.merkle import op12_merkle
from tracelake.llm.sentencepiece_tok import op8_sentencepiece
from tracelake.llm.sharding import op13_shards
from tracelake.llm.simhash import op1_simhash
from tracelake.llm.token_cache import op10_token_counts
from tracelake.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_html_text": op4_html_text,
    "op5_gru_lm": op5_gru_lm,
    "op6_chat_format": op6_chat_format,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle": op12_merkle,
    "op13_shards": op13_shards,
}

#: Characters that the template escapes, and the order of roles that it accepts.
_TURNS = r"""SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS "text" FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'"""
_ESCAPED = r"length({0}) + length(regexp_replace({0}, '[^\\#<:]', '', 'g'))"

#: The others need hashes, models or tokenizers that SQL lacks; tests compare them with plain versions.
ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": rf"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || "text" || chr(10), '' ORDER BY turn NULLS FIRST, role, "text")) AS turns_sha256,
        CAST(coalesce(sum(length("text")) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg("text", '' ORDER BY turn NULLS FIRST, role, "text") FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(14 + {_ESCAPED.format('role')} + {_ESCAPED.format('"text"')}) AS BIGINT) AS formatted_chars,
        regexp_matches(string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, "text"), '^(system,)?(user,assistant,)*(user,)?$') AS valid
        FROM ({_TURNS}) GROUP BY 1""",
    "op11_vector_codes": twins.vector_codes(),
    "op12_merkle": twins.merkle(),
    "op13_shards": twins.shards(),
}
