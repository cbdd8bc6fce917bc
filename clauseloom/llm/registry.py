"""The queries of this subpackage and the SQL to check them with, as __spark_entry__ takes them."""

from __future__ import annotations

from clauseloom.llm import p1_lookalikes as p1, p2_neighbours as p2, p3_encoding as p3, p4_boilerplate as p4, p5_truncation as p5, p6_packing as p6, p7_leaks as p7, p8_spam as p8

QUERIES = {
    "p1_found": p1.p1_found,
    "p1_consistent_passages": p1.p1_consistent_passages,
    "p1_consistent_evidence": p1.p1_consistent_evidence,
    "p1_script_report": p1.p1_script_report,
    "p2_found": p2.p2_found,
    "p3_found": p3.p3_found,
    "p3_restored": p3.p3_restored,
    "p4_found": p4.p4_found,
    "p4_cleaned": p4.p4_cleaned,
    "p4_blocks": p4.p4_blocks,
    "p5_found": p5.p5_found,
    "p5_source_rates": p5.p5_source_rates,
    "p5_length_limits": p5.p5_length_limits,
    "p6_containers": p6.p6_containers,
    "p6_fill": p6.p6_fill,
    "p7_found": p7.p7_found,
    "p7_items_leaked": p7.p7_items_leaked,
    "p8_found": p8.p8_found,
    "p8_shares": p8.p8_shares,
}
_REPEATED = r"""
WITH dis AS (SELECT document_id, min(lower(trim(district))) AS district FROM documents WHERE length(trim(district)) > 0 GROUP BY document_id),
pas AS (SELECT DISTINCT passage_id, document_id, text FROM passages),
size AS (SELECT district, count(DISTINCT document_id) AS docs FROM pas JOIN dis USING (document_id) GROUP BY district),
lin AS (SELECT passage_id, document_id, district, generate_subscripts(l, 1) AS line_no, trim(regexp_replace(lower(unnest(l)), '[^\p{L}\p{M}]+', ' ', 'g')) AS key
  FROM (SELECT passage_id, document_id, district, string_split(text, chr(10)) AS l FROM pas JOIN dis USING (document_id) WHERE text IS NOT NULL)),
sup AS (SELECT district, key, count(DISTINCT document_id) AS n FROM lin WHERE len(string_split(key, ' ')) >= 4 GROUP BY ALL)
SELECT DISTINCT passage_id, line_no FROM lin JOIN sup USING (district, key) JOIN size USING (district) WHERE n >= 4 AND n >= 0.1 * docs
"""
_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
"""

_CLEANED = f"""
SELECT passage_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), lambda z: NOT list_contains(coalesce(gone, []), z[2])).list_transform(lambda z: z[1]), chr(10)), '') END AS text
FROM (SELECT DISTINCT passage_id, text FROM passages) LEFT JOIN (SELECT passage_id, list(line_no) AS gone FROM ({_REPEATED}) GROUP BY passage_id) USING (passage_id)
"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": _REPEATED,
    "p4_cleaned": _CLEANED,
    "p7_found": _LEAKS,
    "p7_items_leaked": f"SELECT item_id, count(*) AS n_documents FROM ({_LEAKS}) GROUP BY item_id",
}
