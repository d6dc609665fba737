"""The subpackage's registered queries, and their SQL where SQL can express them."""

from sluice.llm.bpe import op12_bpe
from sluice.llm.decontaminate import op1_decontamination
from sluice.llm.fim import OP11_SQL, op11_fill_in_middle
from sluice.llm.jaccard import op2_jaccard_join
from sluice.llm.merkle import op7_fingerprints
from sluice.llm.packing import op10_packing
from sluice.llm.pii import op6_pii
from sluice.llm.quality import op3_quality
from sluice.llm.runs import op13_periodic_runs
from sluice.llm.sharding import op8_sharding
from sluice.llm.token_files import op9_token_files
from sluice.llm.toxicity import op5_toxicity
from sluice.llm.warc import op4_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe": op12_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op11_fill_in_middle": OP11_SQL,
    "op2_jaccard_join": r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (nx + ny - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1) m USING (doc_id)""",
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
}
