"""Queries of the training-data operators in SQL, by brute force, where SQL can express them. All values are written out here."""

from __future__ import annotations

WHITE = "\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\v"

#: CTEs ending in alike (pairs of similar classes of equal texts, both ways) and member (the ids of each class).
ALIKE = f"""stored AS (SELECT 'raw_text' AS field_name, doc_id AS id, raw_text AS t FROM source_document UNION SELECT 'chunk_text', chunk_id, chunk_text FROM kb_chunk),
bare AS (SELECT DISTINCT field_name, id, regexp_replace(t, '[{WHITE}]+', '', 'g') AS body FROM stored WHERE t IS NOT NULL AND id IS NOT NULL),
body AS (SELECT row_number() OVER (ORDER BY field_name, body) AS n, field_name, body FROM (SELECT DISTINCT field_name, body FROM bare WHERE length(body) >= 5)),
gram AS (SELECT DISTINCT n, field_name, g FROM (SELECT n, field_name, unnest(list_transform(range(1, length(body) - 3), lambda i: hash(substring(body, i, 5)))) AS g FROM body)),
size AS (SELECT n, count(*) AS m FROM gram GROUP BY 1),
near AS (SELECT a.n AS x, b.n AS y, count(*) AS shared FROM gram a JOIN gram b ON a.g = b.g AND a.field_name = b.field_name AND a.n < b.n GROUP BY 1, 2),
pair AS (SELECT x, y FROM near JOIN size p ON p.n = x JOIN size q ON q.n = y WHERE shared >= 0.7 * (p.m + q.m - shared)),
alike AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
member AS (SELECT n, s.field_name, id FROM bare s JOIN body b ON s.field_name = b.field_name AND s.body = b.body)"""

_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def folded(column: str) -> str:
    return f"regexp_replace(lower(translate({column}, '{_WIDE}', '{_PLAIN}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


SQL: dict[str, str] = {
    "p1_round_trip": f"SELECT chunk_id, coalesce(length(t), 0)::INT AS visible, md5(t) AS hash FROM (SELECT DISTINCT ON (chunk_id) chunk_id, regexp_replace(coalesce(chunk_text, ''), '[{WHITE}]+', '', 'g') AS t FROM kb_chunk)",
    "p4_round_trip": """WITH item AS (SELECT DISTINCT 'chunk_text' AS field_name, chunk_id AS record_id, 0 AS item_no, chunk_text AS t FROM kb_chunk
  UNION SELECT 'paragraphs', doc_id, generate_subscripts(paragraphs, 1) - 1, unnest(paragraphs) FROM source_document)
SELECT field_name, record_id, item_no::INT AS item_no, length(t)::INT AS n_chars, md5(t) AS hash, true AS fits FROM item WHERE length(t) > 800""",
    "p5_found": f"""WITH {ALIKE}, linked AS (SELECT x, y FROM alike UNION ALL SELECT n, n FROM body)
SELECT DISTINCT a.field_name, a.id AS id_a, b.id AS id_b FROM linked JOIN member a ON a.n = x JOIN member b ON b.n = y WHERE a.id < b.id""",
    "p5_groups": f"""WITH RECURSIVE {ALIKE},
reach AS (SELECT n, n AS m FROM body UNION SELECT r.n, l.y FROM reach r JOIN alike l ON l.x = r.m),
class AS (SELECT n, min(id) AS class_id, count(DISTINCT id) AS ids FROM member GROUP BY 1),
grouped AS (SELECT r.n, min(class_id) AS group_id FROM reach r JOIN class c ON c.n = r.m GROUP BY 1),
linked AS (SELECT x AS n, sum(ids)::BIGINT AS links FROM alike JOIN class c ON c.n = y GROUP BY 1)
SELECT DISTINCT field_name, id AS record_id, class_id, group_id, ids - 1 AS copies, coalesce(links, 0) AS links FROM member JOIN class USING (n) JOIN grouped USING (n) LEFT JOIN linked USING (n)""",
    "p7_found": f"""WITH own AS (SELECT item_id, {folded("passage")} AS t FROM eval_item WHERE passage IS NOT NULL), doc AS (SELECT doc_id, {folded("text")} AS t FROM documents WHERE text IS NOT NULL),
item AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 38), lambda i: substring(t, i, 40))) AS s FROM own WHERE length(t) >= 40),
stretch AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 38), lambda i: substring(t, i, 40))) AS s FROM doc WHERE length(t) >= 40)
SELECT DISTINCT doc_id, item_id FROM item JOIN stretch USING (s)""",
    "p9_counts": f"""WITH line AS (SELECT doc_id, regexp_replace(unnest(string_split({_LOWER}, chr(10))), '^[{WHITE}]+|[{WHITE}]+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS own FROM line WHERE x <> '' GROUP BY 1),
gram AS (SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(length(text) - 9, 0) + 1), lambda i: substring({_LOWER}, i, 10)))) AS own FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(length(regexp_replace(text, '[{WHITE}]', '', 'g')), 0) AS visible,
  coalesce(length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{20000}}-\\x{{3ffff}}\\x{{f900}}-\\x{{faff}}\\x{{2e80}}-\\x{{2fdf}}\\x{{3005}}-\\x{{3007}}]', '', 'g')), 0) AS han,
  coalesce(lines.n, 0) AS lines, coalesce(lines.n - lines.own, 0) AS repeated_lines, coalesce(greatest(length(text) - 9, 0), 0) AS grams, coalesce(greatest(length(text) - 9, 0) - gram.own, 0) AS repeated_grams
FROM documents LEFT JOIN lines USING (doc_id) LEFT JOIN gram USING (doc_id)""",
}
