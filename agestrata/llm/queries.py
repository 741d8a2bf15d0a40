"""The registered queries of this package and, where SQL can express them, their SQL."""

from agestrata.llm.codes import SQL as CODES_SQL
from agestrata.llm.codes import op11_partial_distance_codes
from agestrata.llm.language import op10_byte_cnn_language
from agestrata.llm.licenses import SQL as LICENSE_SQL
from agestrata.llm.licenses import op4_sentence_rule_licenses
from agestrata.llm.mixing import op8_pareto_mix
from agestrata.llm.packing import op2_power_of_two_packing
from agestrata.llm.phrases import op1_phrase_fingerprints
from agestrata.llm.privacy import op7_boosted_candidates
from agestrata.llm.quality import RULES, STOP_WORDS, op3_quality_rules
from agestrata.llm.sharding import op9_ring_shards
from agestrata.llm.simhash import op5_pigeonring_simhash
from agestrata.llm.suffixes import op6_lyndon_suffix_dedup
from agestrata.llm.tokens import op12_token_counts
from agestrata.llm.whitening import op13_residue_whitening

QUERIES = {
    "op1_phrase_fingerprints": op1_phrase_fingerprints,
    "op2_power_of_two_packing": op2_power_of_two_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentence_rule_licenses": op4_sentence_rule_licenses,
    "op5_pigeonring_simhash": op5_pigeonring_simhash,
    "op6_lyndon_suffix_dedup": op6_lyndon_suffix_dedup,
    "op7_boosted_candidates": op7_boosted_candidates,
    "op8_pareto_mix": op8_pareto_mix,
    "op9_ring_shards": op9_ring_shards,
    "op10_byte_cnn_language": op10_byte_cnn_language,
    "op11_partial_distance_codes": op11_partial_distance_codes,
    "op12_token_counts": op12_token_counts,
    "op13_residue_whitening": op13_residue_whitening,
}

RULE_SQL = [
    f"({r.whole} = 0 or ({r.part} / {r.whole} >= {r.low if r.low is not None else '-1e18'} and {r.part} / {r.whole} <= {r.high if r.high is not None else '1e18'}))"
    for r in RULES
]
#: Words, their 3-word windows and the positions that repeated windows cover, by unnesting.
QUALITY_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, regexp_split_to_array(t, '\n') as ls from d),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
h as (select doc_id, i, ws[i:i+2] as gram from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from h) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, (values (0), (1), (2)) as o(k) group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as n_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
  coalesce(c.n, 0) as n_repeat_words,
  len(list_filter(ws, lambda x: x in ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) as n_stop_words,
  len(list_filter(ws, lambda x: x = upper(x) and length(x) > 1)) as n_loud_words
  from w left join c on c.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 1 as one from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and {" and ".join(RULE_SQL)} as kept
from b
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": QUALITY_SQL, "op4_sentence_rule_licenses": LICENSE_SQL, "op11_partial_distance_codes": CODES_SQL}
