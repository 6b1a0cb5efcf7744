"""Queries of this subpackage, each an operator with production parameters over its whole table."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_collocations
from .decontam import op1_decontam
from .fingerprints import op7_fingerprints
from .html_text import op6_html_text
from .langid import op9_langid
from .mixing import op13_mix
from .neardup import op10_neardup
from .ngram_lm import op4_lm_score
from .packing import op2_packing
from .pii import op3_pii
from .ranked import OP12_SQL, op12_search
from .token_store import op8_token_store
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_decontam": op1_decontam,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_lm_score": op4_lm_score,
    "op5_warc": op5_warc,
    "op6_html_text": op6_html_text,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_store": op8_token_store,
    "op9_langid": op9_langid,
    "op10_neardup": op10_neardup,
    "op11_collocations": op11_collocations,
    "op12_search": op12_search,
    "op13_mix": op13_mix,
}

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(a[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)
),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 75 * (na.k + nb.k - both_)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(k, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN root USING (doc_id)
"""

ORACLES = {"op5_warc": OP5_SQL, "op10_neardup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_search": OP12_SQL}
