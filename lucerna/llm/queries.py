"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lucerna.llm.decontaminate import op2_decontamination
from lucerna.llm.line_dedup import op9_line_dedup
from lucerna.llm.lexical import op12_lexical_search
from lucerna.llm.lm import op7_lm_scores
from lucerna.llm.mixing import op11_source_mixing
from lucerna.llm.near_dup import op6_near_duplicates
from lucerna.llm.quality import op5_quality_rules
from lucerna.llm.runs import op13_periodic_runs
from lucerna.llm.secrets import op4_secret_scans
from lucerna.llm.sharding import op1_sharding
from lucerna.llm.token_files import op3_token_files
from lucerna.llm.tokens import op8_encode_decode, op10_token_counts

QUERIES = {
    "op7_lm_scores": op7_lm_scores,
    "op9_line_dedup": op9_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op1_sharding": op1_sharding,
    "op3_token_files": op3_token_files,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op8_encode_decode": op8_encode_decode,
    "op10_token_counts": op10_token_counts,
    "op11_source_mixing": op11_source_mixing,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    # exact sets, all links, least document reached
    "op6_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id""",
    # targets: sources by their bound over their weight; the first level that no later bound is under holds
    "op11_source_mixing": """WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k FROM w),
p AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(source_size) OVER () AS total, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o),
l AS (SELECT k AS level, (total - 3 * below)::BIGINT AS rest, open_weight::BIGINT AS ow FROM p WHERE 3 * source_size * open_weight >= weight * (total - 3 * below) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k < level THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / ow::DOUBLE END AS target FROM p, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3 * 268435456, round(target / source_size * 268435456)::BIGINT) ELSE 0 END AS each,
('0x' || substr(md5('11:' || coalesce('+' || source, '-')), 1, 7))::BIGINT AS start FROM t),
n AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.each, e.start + e.each * row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS upto FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN ((upto >> 28) - ((upto - each) >> 28)) * size ELSE 0 END)::BIGINT AS taken FROM n""",
    # item terms once each; every document that holds one
    "op12_lexical_search": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
x AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d WHERE len(t) > 0), c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
f AS MATERIALIZED (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM x GROUP BY ALL), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, n_docs),
y AS (SELECT q, item_id, unnest(t) AS term FROM i),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score FROM y JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10""",
}
