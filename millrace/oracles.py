"""The engine's own queries in SQL, for comparison. All values are written out here, so that a wrong one in an operator shows."""

from __future__ import annotations

HAN = "[\\x{4e00}-\\x{9fff}]+"
WHITE = "\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\v"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{WHITE}]+', ' ', 'g')")


def distinct(xs: str) -> str:
    """The distinct values of a list, in order."""
    return f"list_transform([{xs}], lambda own: list_filter(own, lambda x, i: list_position(own, x) = i))[1]"


def terms(rows: str, key: str, column: str, name: str) -> str:
    """CTEs ending in ``name``(id, term)."""
    return f"""
{name}_folded AS (SELECT {key} AS id, replace(lower({column}), 'ß', 'ss') AS t FROM {rows} WHERE {column} IS NOT NULL),
{name}_pieces AS (SELECT id, unnest(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+')) AS p FROM {name}_folded),
{name}_spans AS (SELECT id, unnest(regexp_extract_all(t, '{HAN}')) AS s FROM {name}_folded),
{name} AS (
  SELECT id, p AS term FROM {name}_pieces WHERE length(p) > 1 AND NOT regexp_full_match(p, '{HAN}')
  UNION SELECT id, s FROM {name}_spans WHERE length(s) <= 8
  UNION SELECT id, unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) FROM {name}_spans WHERE length(s) >= 2
  UNION SELECT id, unnest(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) FROM {name}_spans WHERE length(s) >= 3
  UNION SELECT id, unnest(list_transform(range(1, length(s) - 2), lambda i: substring(s, i, 4))) FROM {name}_spans WHERE length(s) >= 4
)"""


QUESTIONS = "(SELECT item_id AS query_id, question AS query FROM eval_item)"
CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM kb_chunk)"
SOURCES = "(SELECT * FROM source_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(ingestion_time, TIMESTAMP '1970-01-01') DESC, raw_text DESC NULLS LAST, title DESC NULLS LAST, parse_status DESC NULLS LAST) = 1)"


def corpus(rows: str, key: str, column: str, asked: str) -> str:
    """CTEs terms, lengths, corpus, stats and asked(id, term)."""
    return f"""{terms(rows, key, column, "terms")},
lengths AS (SELECT d.{key} AS id, count(t.term) AS length FROM {rows} d LEFT JOIN terms t ON d.{key} = t.id GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lengths),
stats AS (SELECT term, count(*) AS df FROM terms GROUP BY 1),{terms(asked, "query_id", "query", "asked")}"""


MATCHED = "string_agg(a.term, '|' ORDER BY a.term)"


def bm25(rows: str, key: str, column: str, asked: str, where: str = "") -> str:
    """CTEs ending in ranked(query_id, id, score, rank, match_terms), the best five of each question."""
    return f"""{corpus(rows, key, column, asked)},
scored AS (
  SELECT a.id AS query_id, t.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / avgdl) + 1e-9)) AS score, {MATCHED} AS match_terms
  FROM asked a JOIN stats s USING (term) JOIN terms t USING (term) JOIN lengths l ON t.id = l.id CROSS JOIN corpus {where} GROUP BY 1, 2),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5)"""


TOP = " SELECT query_id, id AS doc_id, rank::INT AS rank, round(score, 6) AS score, match_terms FROM ranked"

# ---- sentences ----

END = "[。！？!?；;]"
MARKER = "第[一二三四五六七八九十百千万0-9]+条|第[一二三四五六七八九十百千万0-9]+款|[（(][一二三四五六七八九十0-9]+[)）]|[一二三四五六七八九十]+、|[0-9]+[、.]"
SHORT_MARKER = "^(?:第[一二三四五六七八九十百千万0-9]+[条款]|[（(][一二三四五六七八九十0-9]+[)）]|[一二三四五六七八九十]+、|[0-9]+[、.])"


def cleaned(xs: str) -> str:
    return f"list_filter(list_transform({xs}, lambda p: regexp_replace(p, '^[ ，、]+|[ ，、]+$', '', 'g')), lambda p: length(p) > 0)"


def packed(xs: str) -> str:
    fold = f"list_reduce(list_transform({xs}, lambda p: {{'done': []::VARCHAR[], 'open': p}}), lambda a, b: CASE WHEN a.open <> '' AND length(a.open) + length(b.open) > 120 THEN {{'done': list_append(a.done, {trim('a.open')}), 'open': b.open}} ELSE {{'done': a.done, 'open': a.open || b.open}} END)"
    return f"list_transform([{fold}], lambda r: CASE WHEN r.open <> '' THEN list_append(r.done, {trim('r.open')}) ELSE r.done END)[1]"


def sentences(rows: str, key: str, column: str) -> str:
    """CTEs ending in sentences(id, sentence_no, sentence)."""
    return f"""
s_text AS (SELECT {key} AS id, {trim(f"regexp_replace(regexp_replace(regexp_replace(replace({column}, chr(12288), ' '), '\\r\\n?', chr(10), 'g'), '[ \\t]*\\n+[ \\t]*', chr(10), 'g'), '[\\t\\r\\f\\v ]+', ' ', 'g')")} AS t FROM {rows} WHERE {column} IS NOT NULL),
s_line AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM s_text),
s_parts AS (SELECT id, i, {cleaned(f"string_split(regexp_replace({trim('line')}, '({END})', '\\1' || chr(1), 'g'), chr(1))")} AS xs FROM s_line),
s_coarse AS (SELECT id, i, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM s_parts),
s_cut AS (SELECT *, CASE WHEN length(x) > 120 THEN list_filter(range(2, length(x) + 1), lambda p: regexp_matches(substring(x, p), '^(?:{MARKER})')) ELSE [] END AS places FROM s_coarse),
s_both AS (SELECT *, {cleaned("list_transform(range(1, len(places) + 2), lambda k: substring(x, list_concat([1], places)[k], list_concat(places, [length(x) + 1])[k] - list_concat([1], places)[k]))")} AS marked, {cleaned("string_split(regexp_replace(x, '([，、：:])', '\\1' || chr(1), 'g'), chr(1))")} AS clauses FROM s_cut),
s_finer AS (SELECT id, i, j, CASE WHEN length(x) <= 120 THEN [x] WHEN len(marked) > 1 THEN {packed("marked")} WHEN len(clauses) > 1 THEN {packed("clauses")} ELSE [x] END AS xs FROM s_both),
s_fine AS (SELECT id, i, j, {trim('unnest(xs)')} AS x, generate_subscripts(xs, 1) AS k FROM s_finer),
s_list AS (SELECT id, list([x] ORDER BY i, j, k) AS xs FROM s_fine WHERE x <> '' GROUP BY id),
s_joined AS (SELECT id, list_reduce(xs, lambda a, b: CASE WHEN length(b[1]) <= 8 AND NOT regexp_matches(b[1], '{SHORT_MARKER}') THEN list_append(list_slice(a, 1, len(a) - 1), a[len(a)] || b[1]) ELSE list_concat(a, b) END) AS xs FROM s_list),
sentences AS (SELECT id, (generate_subscripts(xs, 1) - 1)::INT AS sentence_no, unnest(xs) AS sentence FROM s_joined)"""


# ---- evidence ----

GENERIC_SENTENCE = "为贯彻|根据|依据|现将|如下|通知如下|有关事项|工作要求"
GENERIC_INTRODUCTION = "为贯彻|根据|现将|通知如下|工作要求|总体要求|指导思想"


def evidence(asked: str) -> str:
    """CTEs ending in chosen (the evidence rows of each question) and sure (its confidence)."""
    return f"""{bm25(CHUNKS, "chunk_id", "chunk_text", asked)},
near AS (SELECT query_id, r.id AS chunk_id, score AS retrieval_score, rank AS retrieval_rank, doc_id, chunk_text, source_title, section_title FROM ranked r JOIN {CHUNKS} c ON r.id = c.chunk_id WHERE rank <= 3),
near_text AS (SELECT DISTINCT chunk_id, chunk_text FROM near),{sentences("near_text", "chunk_id", "chunk_text")},
sentence_row AS (SELECT id AS chunk_id, sentence_no, sentence, id || '#' || sentence_no AS sid FROM sentences),{terms("sentence_row", "sid", "sentence", "sentence_term")},
sizes AS (SELECT id, count(*) AS n FROM sentence_term GROUP BY 1),
asked_size AS (SELECT id, count(*) AS n FROM asked GROUP BY 1),
hit AS (SELECT n.query_id, s.sid, count(*) AS overlap, {MATCHED} AS matched_terms FROM near n JOIN sentence_row s USING (chunk_id) JOIN sentence_term t ON t.id = s.sid JOIN asked a ON a.id = n.query_id AND a.term = t.term GROUP BY 1, 2),
measured AS (
  SELECT n.*, s.sentence_no, s.sentence, h.overlap, h.matched_terms, h.overlap / greatest(q.n, 1) AS coverage, h.overlap / (q.n + z.n - h.overlap) AS jaccard, h.overlap / greatest(z.n, 1) AS lexical_density,
    CASE WHEN length(sentence) > 18 AND regexp_matches(sentence, '{GENERIC_SENTENCE}') AND h.overlap <= 2 THEN 0.12 ELSE 0.0 END::DOUBLE AS generic_penalty
  FROM near n JOIN sentence_row s USING (chunk_id) JOIN hit h ON h.query_id = n.query_id AND h.sid = s.sid JOIN sizes z ON z.id = s.sid JOIN asked_size q ON q.id = n.query_id),
weighed AS (SELECT *, greatest(0.0, least(1.0, coverage * 0.45::DOUBLE + lexical_density * 0.25::DOUBLE + jaccard * 0.20::DOUBLE + least(retrieval_score, 1.0) * 0.15::DOUBLE + least(overlap, 4) * 0.03::DOUBLE - generic_penalty)) AS score FROM measured),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(coverage, 9) DESC, overlap DESC, round(retrieval_score, 9) DESC, length(sentence), retrieval_rank, sentence_no) AS place FROM weighed),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id, sentence ORDER BY place) AS copy FROM placed WHERE place <= 9),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS evidence_rank, chunk_id || ':sent-' || place AS evidence_id,
    trim(coalesce(source_title, '') || CASE WHEN coalesce(section_title, '') <> '' THEN ' - ' || section_title ELSE '' END) AS citation_text FROM once WHERE copy = 1) WHERE evidence_rank <= 3),
generic AS (SELECT query_id, sum((overlap <= 2 AND regexp_matches(sentence, '{GENERIC_INTRODUCTION}'))::INT) AS generic_hits, count(*) AS n, avg(score) AS average, max(overlap) AS best FROM chosen GROUP BY 1),
seen AS (SELECT query_id, count(*) AS m, string_agg(term, '|' ORDER BY term) AS matched_terms FROM (SELECT DISTINCT c.query_id, unnest(string_split(matched_terms, '|')) AS term FROM chosen c) GROUP BY 1),
judged AS (
  SELECT q.query_id, coalesce(z.n, 0) AS terms, g.*, s.m, s.matched_terms, s.m / greatest(z.n, 1) AS coverage FROM {asked} q LEFT JOIN asked_size z ON z.id = q.query_id LEFT JOIN (SELECT query_id AS gid, generic_hits, n, average, best FROM generic) g ON g.gid = q.query_id LEFT JOIN seen s ON s.query_id = q.query_id),
graded AS (
  SELECT *, CASE WHEN terms <= 0 THEN 0.1 WHEN n IS NULL THEN 0.08 ELSE greatest(0.0, least(1.0, average * 0.55::DOUBLE + coverage * 0.45::DOUBLE - CASE WHEN best <= 1 THEN 0.22 ELSE 0 END::DOUBLE - CASE WHEN coverage < 0.35 THEN 0.18 ELSE 0 END::DOUBLE - CASE WHEN generic_hits = n THEN 0.15 ELSE 0 END::DOUBLE)) END::DOUBLE AS score FROM judged),
sure AS (
  SELECT query_id, round(score, 4) AS confidence, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS label,
    CASE WHEN terms <= 0 THEN '查询缺少可用于匹配的关键词，证据置信度较低。' WHEN n IS NULL THEN '未选出有效证据句，建议放宽检索或提示用户补充条件。' WHEN score >= 0.45 THEN NULL
      WHEN generic_hits = n THEN '当前命中的多为政策导语或一般性说明，缺少直接回答问题的条款。' WHEN coverage < 0.35 THEN '证据句覆盖的查询关键词较少，回答可能不够准确，建议补充更具体条件。' ELSE '查询与证据句匹配较弱，建议回退为低置信提示或请求用户澄清。' END AS warning,
    CASE WHEN terms <= 0 THEN 'empty_query_terms' WHEN n IS NULL THEN 'no_evidence' ELSE array_to_string(list_filter([CASE WHEN best <= 1 THEN 'weak_term_overlap' END, CASE WHEN coverage < 0.35 THEN 'low_query_coverage' END, CASE WHEN generic_hits = n THEN 'generic_intro_only' END], lambda x: x IS NOT NULL), '|') END AS reasons,
    CASE WHEN terms > 0 THEN matched_terms END AS matched_terms, CASE WHEN terms > 0 THEN round(coverage, 4) END AS coverage, best::INT AS best_sentence_overlap, generic_hits::BIGINT AS generic_hits FROM graded)"""


# ---- parameters ----

AMOUNT = "\\d+(?:\\.\\d+)?\\s*(?:亿元|万元|万|千元|元)"


def first(texts: str, of: str) -> str:
    """The first value over the texts that is not null; ``of`` is an expression of t."""
    return f"list_filter(list_transform({texts}, lambda t: {of}), lambda v: v IS NOT NULL)[1]"


def percent(texts: str, *hints: str) -> str:
    return first(texts, "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{h}[^%％\\d]{{0,12}}(\\d+(?:\\.\\d+)?)\\s*[%％]', 1), '')" for h in hints) + ")::DOUBLE")


def requirement(texts: str, *hints: str) -> str:
    sentence = first(texts, trim("coalesce(" + ", ".join(f"nullif(regexp_extract(t, '([^。；;\\n]*{h}[^。；;\\n]*)', 1), '')" for h in hints) + ")"))
    return f"NOT regexp_matches({sentence}, '免|无需|不需|无须|信用')"


def listed(texts: str, pattern: str) -> str:
    bare = f"""trim(regexp_replace(regexp_replace({collapse("coalesce(v, '')")}, '^[：:，,、 ]+|[：:，,、 ]+$', '', 'g'), '^[为是]', ''))"""
    found = f"list_filter(list_transform(flatten(list_transform({texts}, lambda t: regexp_extract_all(t, '{pattern}', 1))), lambda v: {bare}), lambda v: v <> '')"
    return f"array_to_string({distinct(found)}, '|')"


def limit(texts: str) -> str:
    hits, gaps = f"regexp_extract_all(t, '{AMOUNT}')", f"regexp_split_to_array(t, '{AMOUNT}')"
    place = f"(1 + list_sum(list_transform(list_slice({gaps}, 1, k), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice({hits}, 1, k - 1), lambda h: length(h))), 0))::INT"
    good = f"regexp_matches(substring(t, greatest({place} - 16, 1), {place} - greatest({place} - 16, 1)), '最高|上限|不超过|最高可贷|额度')"
    hit = first(texts, f"{hits}[list_filter(range(1, len({hits}) + 1), lambda k: {good})[1]]")
    return f"list_transform([{hit}], lambda h: regexp_extract(h, '^\\d+(?:\\.\\d+)?')::DOUBLE * CASE regexp_extract(h, '(亿元|万元|万|千元|元)$') WHEN '亿元' THEN 1e8 WHEN '万元' THEN 1e4 WHEN '万' THEN 1e4 WHEN '千元' THEN 1e3 ELSE 1 END)[1]"


def parameters(texts: str) -> str:
    """Columns of what the texts state."""
    return f"""{percent(texts, "利率", "年利率", "执行利率", "贷款利率", "综合利率")} AS interest_rate, {percent(texts, "贴息", "财政贴息", "补贴比例", "贴息比例", "利息补助")} AS subsidy_rate,
{first(texts, "coalesce(nullif(regexp_extract(t, '(\\d{1,3})\\s*个?月', 1), '')::INT, nullif(regexp_extract(t, '(\\d{1,2})\\s*年', 1), '')::INT * 12)")} AS loan_term_months, {limit(texts)} AS loan_amount_upper_limit,
{requirement(texts, "抵押", "质押", "抵押物", "担保物")} AS collateral_required, {requirement(texts, "担保", "保证人", "第三方保证", "连带责任保证")} AS guarantee_required,
{listed(texts, "(?:适用对象|支持对象|适用主体|服务对象|扶持对象|贷款对象|面向)[:：]?\\s*([^。；;\\n]+)")} AS target_entities,
{listed(texts, "(?:贷款用途|资金用途|用于|专项用于|仅限用于|不得用于|禁止用于)[:：]?\\s*([^。；;\\n]+)")} AS usage_restrictions,
{listed(texts, "(?:还款方式|还款要求|还款约束|偿还方式|到期还本|按月付息|分期还款|随借随还)[:：]?\\s*([^。；;\\n]+)?")} AS repayment_constraints"""


def texts(*columns: str) -> str:
    return f"list_transform(list_filter(list_concat({', '.join(columns)}), lambda t: coalesce({trim('t')}, '') <> ''), lambda t: {collapse('t')})"


# ---- questions ----

ALIASES = {
    "贷款": ("intent", ["借点钱", "借个钱", "借钱", "周转", "周转下", "周转一下", "垫钱", "垫一下", "垫点钱", "资金周转"]),
    "农业生产资料投入": ("purpose", ["买化肥", "购化肥", "化肥款", "买种子", "购种子", "种子款", "买饲料", "购饲料", "饲料款", "买农药", "买农资", "农资投入"]),
    "未结清贷款": ("constraint", ["没还完", "还没还完", "还有没还完", "没还清", "未还完", "还有一点没还完", "还有欠款", "还有贷款没结清"]),
    "还款困难": ("constraint", ["还不上", "还不起", "还款压力大", "暂时还不上", "还款困难"]),
    "续贷": ("action", ["续一下", "续贷一下", "续上", "续办", "接着贷"]),
}
KNOWN = ("农业生产资料投入", "未结清贷款", "还款困难", "贷款", "续贷")
STOP = "['我', '我们', '想', '我想', '想问', '请问', '一下', '一下子', '还有', '一点', '现在', '去年', '今年', '这个', '那个', '能不能', '可以', '看看']"
_EVERY = "|".join(sorted((a for _, xs in ALIASES.values() for a in xs), key=len, reverse=True))
_TERM = "CASE h " + " ".join(f"WHEN '{a}' THEN '{t}'" for t, (_, xs) in ALIASES.items() for a in xs) + " END"
_KIND = "CASE h " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, (k, _) in ALIASES.items()) + " END"


def normalized(asked: str) -> str:
    """CTEs ending in normal(query_id, query, normalized_query, detected_terms, search_text, hits)."""
    known = "[" + ", ".join(f"'{t}'" for t in KNOWN) + "]"
    rest, found = "mapped", []
    for t in KNOWN:
        found.append(f"list_transform(range(((length({rest}) - length(replace({rest}, '{t}', ''))) / {len(t)})::BIGINT), lambda z: '{t}')")
        rest = f"replace({rest}, '{t}', ' ')"
    words = f"list_filter(string_split({collapse(rest)}, ' '), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9a-zA-Z]+'))"
    return f"""
n_bare AS (SELECT query_id, query, {collapse(f"regexp_replace({collapse('query')}, '[，。、；：（）【】？！,.;:()\\[\\]?!]', ' ', 'g')")} AS bare FROM {asked}),
n_hits AS (SELECT *, regexp_extract_all(bare, '{_EVERY}') AS aliases, regexp_split_to_array(bare, '{_EVERY}') AS gaps FROM n_bare),
n_terms AS (SELECT *, list_transform(aliases, lambda h: {_TERM}) AS names FROM n_hits),
n_mapped AS (SELECT *, array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce(names[k], '')), '') AS mapped,
  list_transform(range(1, len(aliases) + 1), lambda k: (list_sum(list_transform(list_slice(gaps, 1, k), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(aliases, 1, k - 1), lambda g: length(g))), 0))::INT) AS places FROM n_terms),
n_found AS (SELECT *, {distinct("names")} AS led, list_concat({', '.join(found)}, {words}) AS found FROM n_mapped),
n_tokens AS (SELECT *, CASE WHEN len(aliases) > 0 THEN list_concat(led, list_filter(found, lambda w: NOT list_contains(led, w))) ELSE found END AS tokens FROM n_found),
n_kept AS (SELECT *, list_filter(tokens, lambda w: NOT list_contains({STOP}, w)) AS kept FROM n_tokens),
normal AS (SELECT query_id, query, array_to_string(kept, ' ') AS normalized_query, array_to_string({distinct(f"list_concat(led, list_filter(kept, lambda w: list_contains({known}, w)))")}, '|') AS detected_terms,
  coalesce(nullif(array_to_string(kept, ' '), ''), query) AS search_text,
  array_to_string(list_transform(range(1, len(aliases) + 1), lambda k: aliases[k] || ',' || names[k] || ',' || list_transform([names[k]], lambda h: {_KIND})[1] || ',' || places[k] || ',' || (places[k] + length(names[k]))), '|') AS hits FROM n_kept)"""


# ---- paragraphs, headings, chunks ----

SUFFIXES = "条件|范围|材料|流程|期限|对象|要求|标准|方式|程序|附则"
_IS_HEADING = f"""(length(p) > 0 AND NOT contains(p, chr(10)) AND (
  regexp_matches(p, '^#{{1,6}}\\s+.+$') OR regexp_matches(p, '^[一二三四五六七八九十百千]+、\\s*.+$')
  OR regexp_matches(p, '^第[一二三四五六七八九十百千0-9]+[章节条款部分编]\\s*.*$') OR regexp_matches(p, '^(?:[(（]?[0-9]+[)）]|[0-9]+[.、])\\s*.+$')
  OR (length(p) <= 30 AND NOT regexp_matches(right(p, 1), '[。；;！!？?：:，,]') AND NOT regexp_matches(p, '[。！？!?；;]') AND regexp_matches(p, '[\\p{{L}}\\p{{Nd}}\\p{{No}}]')
      AND (regexp_matches(p, '^(?:附件|附录|说明|注：|备注：|一是|二是|三是|四是|五是|六是)') OR regexp_matches(p, '(?:{SUFFIXES})$') OR length(p) <= 12))))"""
PARAGRAPHS = f"""WITH own AS (SELECT doc_id, CASE WHEN len(paragraphs) > 0 THEN paragraphs ELSE list_filter(list_transform(string_split(raw_text, chr(10) || chr(10)), lambda x: {trim("x")}), lambda x: x <> '') END AS ps FROM {SOURCES}),
raw AS (SELECT doc_id, unnest(ps) AS q, generate_subscripts(ps, 1) - 1 AS para_no FROM own),
trimmed AS (SELECT doc_id, para_no, {trim("q")} AS p FROM raw),
marked AS (SELECT *, {_IS_HEADING} AS head FROM trimmed),
titled AS (SELECT *, CASE WHEN regexp_matches(p, '^#{{1,6}}\\s+.+$') THEN {trim("regexp_replace(p, '^#+', '')")} ELSE p END AS heading FROM marked)"""
SECTIONS = f"""{PARAGRAPHS}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) - 1 AS no FROM titled WHERE p <> ''),
numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS section_no FROM kept)"""

_SEED = "{{'t': {t}, 'f': {f}, 'l': {l}, 'sec': {sec}}}"


def _join(a: str, b: str, between: str) -> str:
    return _SEED.format(t=f"{a}.t || {between} || {b}.t", f=f"{a}.f", l=f"{b}.l", sec=f"{a}.sec")


def _pack(elements: str, between: str, closes: str) -> str:
    """Elements {out: [seed], shut}; the packed ones."""
    last, new = "a.out[len(a.out)]", "b.out[1]"
    joined = _join(last, new, between)
    fits = f"NOT a.shut AND {last}.sec = {new}.sec AND length({last}.t) + length({between}) + length({new}.t) <= 800"
    return f"list_reduce({elements}, lambda a, b: CASE WHEN {fits} THEN {{'out': list_append(list_slice(a.out, 1, len(a.out) - 1), {joined}), 'shut': {closes.format(t=f'{last}.t || {between} || {new}.t')}}} ELSE {{'out': list_concat(a.out, b.out), 'shut': b.shut}} END).out"


_FIT = "{a}.sec = {b}.sec AND length({a}.t) + 2 + length({b}.t) <= 800"
_GAP = "chr(10) || chr(10)"


def _merge(elements: str) -> str:
    """Elements {out: [seed], eos}; short ones joined with the next, a short last one of a section with the one before."""
    last, new = "a.out[len(a.out)]", "b.out[1]"
    one = f"CASE WHEN length({last}.t) < 233 AND {_FIT.format(a=last, b=new)} THEN list_append(list_slice(a.out, 1, len(a.out) - 1), {_join(last, new, _GAP)}) ELSE list_concat(a.out, b.out) END"
    x, y = "o[len(o) - 1]", "o[len(o)]"
    two = f"CASE WHEN b.eos AND len(o) > 1 AND length({y}.t) < 233 AND {_FIT.format(a=x, b=y)} THEN list_append(list_slice(o, 1, len(o) - 2), {_join(x, y, _GAP)}) ELSE o END"
    return f"list_reduce({elements}, lambda a, b: {{'out': list_transform([{one}], lambda o: {two})[1], 'eos': b.eos}}).out"


CHUNKED = f"""{SECTIONS},
headed AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section_no) AS members, max(heading) FILTER (WHERE head) OVER (PARTITION BY doc_id, section_no) AS title, max(no) FILTER (WHERE head) OVER (PARTITION BY doc_id, section_no) AS heading_no FROM numbered),
body AS (SELECT *, length(p) > 800 AS long FROM headed WHERE NOT (coalesce(heading_no, -1) = no AND no = para_no AND p = title AND members > 1)),
stepped AS (SELECT *, (long IS DISTINCT FROM lag(long) OVER (PARTITION BY doc_id ORDER BY no))::INT AS step FROM body),
runs AS (SELECT *, CASE WHEN long THEN -no - 1 ELSE sum(step) OVER (PARTITION BY doc_id ORDER BY no) END AS run FROM stepped),
cut AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(p, '({END})', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim("x")}), lambda x: x <> '') AS parts FROM runs WHERE long),
cut_packed AS (SELECT doc_id, no, {_pack("list_transform(parts, lambda x: {'out': [" + _SEED.format(t="x", f="para_no", l="para_no", sec="section_no") + "], 'shut': false})", "''", "false")} AS seeds FROM cut WHERE len(parts) > 1),
cut_merged AS (SELECT doc_id, no, {_merge("list_transform(seeds, lambda x, i: {'out': [x], 'eos': i = len(seeds)})")} AS seeds FROM cut_packed
  UNION ALL SELECT doc_id, no, [{_SEED.format(t="p", f="para_no", l="para_no", sec="section_no")}] FROM cut WHERE len(parts) < 2),
short_packed AS (SELECT doc_id, min(no) AS no, {_pack("list({'out': [" + _SEED.format(t="p", f="para_no", l="para_no", sec="section_no") + "], 'shut': length(p) >= 700} ORDER BY no)", _GAP, "length({t}) >= 700")} AS seeds FROM runs WHERE NOT long GROUP BY doc_id, run),
seeds AS (SELECT doc_id, flatten(list(seeds ORDER BY no)) AS seeds FROM (SELECT * FROM cut_merged UNION ALL SELECT * FROM short_packed) GROUP BY 1),
merged AS (SELECT doc_id, {_merge("list_transform(seeds, lambda x, i: {'out': [x], 'eos': i = len(seeds) OR seeds[i + 1].sec <> x.sec})")} AS seeds FROM seeds),
pieces AS (SELECT doc_id, generate_subscripts(seeds, 1) - 1 AS chunk_index, unnest(seeds) AS s FROM merged),
section_title AS (SELECT doc_id, section_no, max(heading) FILTER (WHERE head) AS title FROM numbered GROUP BY 1, 2)
SELECT p.doc_id || ':chunk:' || chunk_index || ':' || substring(sha1(s.t), 1, 10) AS chunk_id, p.doc_id, region, coalesce(nullif(d.title, ''), file_name) AS source_title, s.t AS chunk_text, chunk_index::INT AS chunk_index, x.title AS section_title, s.f::INT AS first_paragraph, s.l::INT AS last_paragraph
FROM pieces p JOIN {SOURCES} d USING (doc_id) LEFT JOIN section_title x ON x.doc_id = p.doc_id AND x.section_no = s.sec WHERE coalesce(parse_status, '') <> 'failed'"""

SEGMENTED = f"""WITH line AS (SELECT doc_id, {trim("unnest(ls)")} AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\v\\f\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM documents WHERE text IS NOT NULL)),
grouped AS (SELECT *, sum((x = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM line),
paragraph AS (SELECT doc_id, g, string_agg(x, chr(10) ORDER BY i) AS paragraph FROM grouped WHERE x <> '' GROUP BY 1, 2),
segmented AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS para_no, paragraph FROM paragraph)"""

PARSED = f"""WITH stored AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, {trim("unnest(ls)")} AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\v\\f\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM stored)),
kind AS (SELECT unnest(['txt', 'md']) AS k),
broken AS (SELECT *, k = 'md' AND regexp_matches(x, '^#{{1,6}}( |$)') AS head FROM line CROSS JOIN kind),
stepped AS (SELECT *, (x = '' OR head OR coalesce(lag(head) OVER (PARTITION BY doc_id, k ORDER BY i), false))::INT AS step FROM broken),
grouped AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, k ORDER BY i) AS g FROM stepped),
paragraph AS (SELECT doc_id, k, g, string_agg(x, chr(10) ORDER BY i) AS p FROM grouped WHERE x <> '' GROUP BY 1, 2, 3),
plain AS (SELECT doc_id, k, count(*) AS n, sum(length(p)) AS c, arg_min(p, g) AS first FROM paragraph GROUP BY 1, 2),
piece AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\(([^()]*)\\)', 1), lambda m: {collapse("m")}), lambda m: length(m) > 1) AS ps FROM stored),
pdf AS (SELECT doc_id, {distinct("ps")} AS ps FROM piece),
pdf_size AS (SELECT doc_id, len(ps) AS n, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) AS c, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) + greatest(len(ps) - 1, 0) AS raw FROM pdf)
SELECT k || '/' || s.doc_id AS doc_id, k AS file_type, coalesce(nullif({trim("CASE WHEN regexp_matches(first, '^#{1,6}( |$)') THEN regexp_replace(first, '^#+', '') ELSE string_split(first, chr(10))[1] END")}, ''), 'file-' || s.doc_id) AS title, coalesce(n, 0)::INT AS n_paragraphs, coalesce(c, 0)::INT AS n_chars,
  CASE WHEN {trim("text")} <> '' THEN 'success' ELSE 'partial' END AS parse_status, CASE WHEN {trim("text")} <> '' THEN 'clean' ELSE 'empty' END AS text_quality_flag, CASE WHEN {trim("text")} = '' THEN 0.25 WHEN k = 'md' THEN 0.90 ELSE 0.92 END::DOUBLE AS source_format_confidence, {trim("text")} = '' AS needs_manual_review, false AS ocr_needed, {trim("text")} = '' AS has_error, ({trim("text")} = '')::INT AS n_warnings
FROM stored s CROSS JOIN kind LEFT JOIN plain USING (doc_id, k)
UNION ALL SELECT 'pdf/' || doc_id, 'pdf', 'file-' || doc_id, n::INT, c::INT, CASE WHEN raw = 0 THEN 'failed' WHEN raw < 80 OR n < 2 THEN 'partial' ELSE 'success' END, CASE WHEN raw = 0 THEN 'empty' ELSE 'low_confidence' END, CASE WHEN raw = 0 THEN 0.0 WHEN raw < 80 OR n < 2 THEN 0.35 ELSE 0.65 END::DOUBLE, raw < 80 OR n < 2, raw < 80 OR n < 2, raw < 80 OR n < 2, 1 FROM pdf_size
UNION ALL SELECT 'image/' || doc_id, 'image', 'file-' || doc_id, 0, 0, 'skipped', 'needs_review', 0.0, true, true, true, 1 FROM stored
UNION ALL SELECT 'xls/' || doc_id, 'xls', 'file-' || doc_id, 0, 0, 'failed', 'needs_review', 0.0, true, false, true, 1 FROM stored"""

# ---- sessions ----

_FLAGS = {
    "existing_loan": ("没有贷款|无贷款|已还清|都还完了|没有未结清", "没还完|未还完|未结清|没结清|还有.*没还|还有一点没还|续贷|展期|旧贷"),
    "cooperative": ("不是合作社|非合作社", "合作社"),
    "guarantor": ("没有担保人|无担保人|没人担保", "担保人|保证人|有人担保|找人担保"),
    "collateral": ("无抵押|没有抵押|没抵押物", "抵押|抵押物|房产作抵押|有抵押物|有抵押"),
}
_SLOTS = {
    "purpose": "CASE WHEN regexp_matches(t, '买化肥|化肥|种子|农药|饲料|农资') THEN '农业生产资料投入' WHEN regexp_matches(t, '周转|流动资金|经营周转') THEN '经营周转' WHEN regexp_matches(t, '扩建|扩大|新建|建棚|建圈舍') THEN '扩大生产' WHEN regexp_matches(t, '购置设备|买设备|农机|机器') THEN '设备购置' END",
    "crop_or_activity": "CASE WHEN regexp_matches(t, '养牛|肉牛|奶牛') THEN '养牛' WHEN regexp_matches(t, '养猪|生猪|育肥猪|母猪') THEN '养猪' WHEN regexp_matches(t, '养羊') THEN '养羊' WHEN regexp_matches(t, '养鸡|蛋鸡|肉鸡') THEN '养鸡' WHEN regexp_matches(t, '养鱼|水产|渔业|养虾') THEN '水产养殖' WHEN regexp_matches(t, '种粮|粮食|小麦|玉米|水稻') THEN '粮食种植' WHEN regexp_matches(t, '果园|苹果|柑橘|葡萄|猕猴桃') THEN '水果种植' WHEN regexp_matches(t, '蔬菜|大棚|设施农业') THEN '设施农业' END",
    "amount": "nullif(regexp_replace(regexp_extract(t, '((?:\\d+(?:\\.\\d+)?)\\s*(?:万元|万|元))', 1), '\\s+', '', 'g'), '')",
    "duration": "nullif(regexp_replace(regexp_extract(t, '((?:\\d+(?:\\.\\d+)?)\\s*(?:个月|月|年)|半年|一年|两年|三年)', 1), '\\s+', '', 'g'), '')",
    **{s: f"CASE WHEN regexp_matches(t, '{no}') THEN false WHEN regexp_matches(t, '{yes}') THEN true END" for s, (no, yes) in _FLAGS.items()},
}
_TURN_SLOTS = "WITH turns AS (SELECT coalesce(region, '') AS session_id, doc_id AS turn, trim(text) AS t FROM documents WHERE text IS NOT NULL), slots AS (SELECT session_id, turn, " + ", ".join(f"{e} AS {s}" for s, e in _SLOTS.items()) + " FROM turns)"

_CORPUS = "WITH " + corpus("documents", "doc_id", "text", QUESTIONS)
_SPOKEN = "(SELECT item_id AS query_id, question AS query FROM eval_item UNION ALL SELECT -item_id - 1, '我想借点钱买化肥，去年还有一点没还完；现在想续一下贷款 abc 吗？' || question FROM eval_item)"
_CITED = """coalesce(nullif({m}source_title, ''), nullif({c}, ''), CASE WHEN k.chunk_id IS NOT NULL THEN k.source_title ELSE {d} END) AS source, coalesce(nullif({m}section_title, ''), nullif(k.section_title, '')) AS section,
coalesce(nullif({c}, ''), CASE WHEN k.chunk_id IS NOT NULL THEN trim(coalesce(k.source_title, '') || CASE WHEN coalesce(k.section_title, '') <> '' THEN ' - ' || k.section_title ELSE '' END) END) AS citation_text"""

SQL: dict[str, str] = {
    "tokenize_documents": f"WITH {terms('documents', 'doc_id', 'text', 'every')}, own AS (SELECT id, count(*) AS n, sum(length(term)) AS c FROM every GROUP BY 1) SELECT doc_id, coalesce(n, 0)::INT AS n_terms, coalesce(c, 0)::INT AS term_chars FROM documents LEFT JOIN own ON doc_id = id WHERE text IS NOT NULL",
    "term_stats": f"WITH {terms('documents', 'doc_id', 'text', 'every')} SELECT term, count(*) AS df FROM every GROUP BY 1",
    "corpus_stats": _CORPUS + " SELECT n AS chunk_count, round(avgdl, 4) AS average_document_length, (SELECT count(*) FROM stats) AS vocabulary_size FROM corpus",
    "bm25_topk": "WITH " + bm25("documents", "doc_id", "text", QUESTIONS) + TOP,
    "bm25_region_topk": "WITH " + bm25("documents", "doc_id", "text", QUESTIONS, "JOIN documents d ON d.doc_id = t.id WHERE upper(d.region) = (SELECT max(upper(region)) FROM documents)") + TOP,
    "tfidf_topk": f"""{_CORPUS},
asked_n AS (SELECT id AS query_id, term, count(*) OVER (PARTITION BY id) AS nt FROM asked),
weights AS (SELECT query_id, term, (ln(1 + (n + 1) / (coalesce(df, 0) + 1)) + 1) AS idf, nt FROM asked_n LEFT JOIN stats USING (term) CROSS JOIN corpus),
norms AS (SELECT query_id, sqrt(sum((idf / nt) * (idf / nt))) AS norm FROM weights GROUP BY 1),
sums AS (SELECT a.query_id, t.id, sum((idf / nt) * (idf / length)) AS dot, sqrt(sum((idf / length) * (idf / length))) AS own, {MATCHED} AS match_terms FROM weights a JOIN terms t USING (term) JOIN lengths l ON l.id = t.id GROUP BY 1, 2),
scored AS (SELECT query_id, id, match_terms, dot / (norm * own) AS score FROM sums JOIN norms USING (query_id)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5){TOP}""",
    "sentence_split": f"WITH {sentences(CHUNKS, 'chunk_id', 'chunk_text')} SELECT id AS chunk_id, sentence_no, sentence FROM sentences",
    "evidence_select": f"""WITH {evidence(QUESTIONS)} SELECT query_id, evidence_rank::INT AS evidence_rank, evidence_id, chunk_id, doc_id, sentence AS evidence_text, round(score, 6) AS confidence, citation_text, round(coverage, 4) AS coverage, overlap::INT AS overlap, round(jaccard, 4) AS jaccard, round(lexical_density, 4) AS lexical_density, round(generic_penalty, 4) AS generic_penalty, retrieval_rank::INT AS retrieval_rank, matched_terms FROM chosen""",
    "evidence_confidence": f"WITH {evidence(QUESTIONS)} SELECT * FROM sure",
    "headings": PARAGRAPHS + " SELECT doc_id, para_no::INT AS para_no, heading FROM titled WHERE head",
    "sections": SECTIONS + " SELECT doc_id, section_no::INT AS section_no, max(heading) FILTER (WHERE head) AS title, min(no)::INT AS start_paragraph, max(no)::INT AS end_paragraph, (max(no) FILTER (WHERE head))::INT AS heading_paragraph FROM numbered GROUP BY 1, 2",
    "chunk_documents": CHUNKED,
    "segment_texts": SEGMENTED + " SELECT * FROM segmented",
    "infer_titles": f"""{SEGMENTED} SELECT d.doc_id, coalesce(nullif({trim("CASE WHEN regexp_matches(s.paragraph, '^#{1,6}( |$)') THEN regexp_replace(s.paragraph, '^#+', '') ELSE string_split(s.paragraph, chr(10))[1] END")}, ''), 'document-' || d.doc_id) AS title FROM documents d LEFT JOIN segmented s ON s.doc_id = d.doc_id AND para_no = 0 WHERE text IS NOT NULL""",
    "parse_files": PARSED,
    "chunk_records": """SELECT chunk_id, coalesce(nullif(doc_id, ''), chunk_id) AS doc_id, coalesce(nullif(region, ''), '') AS region, coalesce(source_title, '') AS source_title, coalesce(chunk_text, '') AS chunk_text, coalesce(chunk_index, 0) AS chunk_index, nullif(section_title, '') AS section_title, page_no, paragraph_range.start AS first_paragraph, paragraph_range."end" AS last_paragraph, metadata['source_path'] AS source_path FROM (SELECT DISTINCT ON (chunk_id) * FROM kb_chunk)""",
    "kb_projection": "SELECT DISTINCT chunk_id, doc_id, region, chunk_index, metadata['source_path'] AS source_path, paragraph_range.start AS first_paragraph, paragraph_range.\"end\" AS last_paragraph FROM kb_chunk",
    "document_ids": """WITH paths AS (SELECT DISTINCT source_path, regexp_replace(source_path, '^/data/raw/', '') AS relative FROM manifest_record WHERE source_path IS NOT NULL),
parts AS (SELECT *, list_concat(string_split(relative, '/'), string_split(source_path, '/')) AS xs, list_extract(string_split(source_path, '/'), -1) AS file_name, regexp_replace(list_extract(string_split(source_path, '/'), -1), '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(source_path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM paths),
named AS (SELECT *, coalesce(list_filter(list_transform(xs, lambda x: CASE WHEN lower(trim(x)) IN ('adbc', 'fj') THEN lower(trim(x)) WHEN lower(trim(x)) = 'fujian' THEN 'fj' WHEN lower(trim(x)) = 'beijing' THEN '北京' WHEN contains(x, '北京') THEN '北京' WHEN starts_with(trim(x), '福建') THEN 'fj' END), lambda r: r IS NOT NULL)[1], 'unknown') AS region FROM parts),
typed AS (SELECT *, CASE WHEN suffix IN ('.doc', '.docx', '.pdf', '.txt', '.html', '.md', '.xls', '.xlsx') THEN suffix[2:] WHEN suffix = '.htm' THEN 'html' WHEN suffix IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff') THEN 'image' ELSE 'unknown' END AS file_type FROM named)
SELECT source_path, file_name, region, file_type, region || ':' || replace(stem, ' ', '_') || ':' || substring(sha1(relative), 1, 10) AS doc_id, sha256(source_path) AS checksum FROM typed WHERE file_type <> 'unknown'""",
    "manifest_backfill": f"SELECT m.doc_id, m.file_type, m.file_size_bytes, d.parse_status, d.parse_error, d.needs_manual_review FROM (SELECT DISTINCT doc_id, file_type, file_size_bytes FROM manifest_record) m LEFT JOIN {SOURCES} d USING (doc_id)",
    "report_counters": f"""SELECT count(*) AS total_files, count(*) FILTER (WHERE parse_status = 'success') AS parsed_successfully, count(*) FILTER (WHERE parse_status = 'partial') AS parsed_partially, count(*) FILTER (WHERE parse_status NOT IN ('success', 'partial')) AS parse_failed, count(*) FILTER (WHERE ocr_needed) AS ocr_required, count(*) FILTER (WHERE needs_manual_review) AS manual_review_required, (SELECT count(DISTINCT chunk_id) FROM kb_chunk) AS chunks_created FROM {SOURCES} d""",
    "extract_parameters": f"""WITH t AS (SELECT evidence_id, {texts("[evidence_text]")} AS ts FROM (SELECT DISTINCT evidence_id, evidence_text FROM selected_evidence)), x AS (SELECT evidence_id, {parameters("ts")} FROM t) SELECT *, round(interest_rate - subsidy_rate, 6) AS effective_rate FROM x""",
    "session_carried": _TURN_SLOTS + " SELECT session_id, turn, " + ", ".join(f"last_value({s} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS {s}" for s in _SLOTS) + " FROM slots",
    "session_latest": _TURN_SLOTS + " SELECT session_id, max(turn) AS turn, " + ", ".join(f"arg_max({s}, turn) FILTER (WHERE {s} IS NOT NULL) AS {s}" for s in _SLOTS) + " FROM slots GROUP BY 1",
    "session_evidence": "WITH turns AS (SELECT doc_id, array_to_string(list_filter([trim(coalesce(text, '')), trim(coalesce(title, ''))], lambda x: x <> ''), chr(10)) AS t FROM documents) SELECT doc_id, " + ", ".join(f"{e} AS {s}" for s, e in _SLOTS.items()) + " FROM turns",
    "citations": f"""SELECT e.evidence_id, e.chunk_id, e.doc_id, {_CITED.format(m="e.metadata.", c="e.citation_text", d="e.doc_id")}, e.evidence_text AS quote, round(e.confidence, 4) AS confidence FROM (SELECT DISTINCT * FROM selected_evidence) e LEFT JOIN {CHUNKS} k USING (chunk_id)""",
    "normalize_questions": f"WITH {normalized(_SPOKEN)} SELECT query_id, normalized_query, detected_terms, search_text, hits FROM normal",
    "ask": f"""WITH {normalized(QUESTIONS)}, search AS (SELECT query_id, search_text AS query FROM normal),{evidence("search")},
best AS (SELECT c.*, {_CITED.format(m="c.", c="c.citation_text", d="c.doc_id").replace("AS citation_text", "AS cited")}, {texts("[c.sentence, k.chunk_text, k.section_title, k.source_title]", "coalesce(map_values(k.metadata), [])")} AS ts FROM chosen c LEFT JOIN {CHUNKS} k USING (chunk_id) WHERE evidence_rank = 1),
stated AS (SELECT query_id, {parameters("ts")} FROM best),
counted AS (SELECT query_id, count(*) AS n FROM chosen GROUP BY 1)
SELECT q.query_id, q.normalized_query, CASE WHEN n IS NULL THEN 'no_result' WHEN interest_rate IS NOT NULL OR subsidy_rate IS NOT NULL OR loan_term_months IS NOT NULL OR loan_amount_upper_limit IS NOT NULL OR collateral_required IS NOT NULL OR guarantee_required IS NOT NULL OR target_entities <> '' OR usage_restrictions <> '' OR repayment_constraints <> '' THEN 'econ_parameterized' WHEN u.label = 'low' THEN 'weak_evidence' ELSE 'normal_hit' END AS scenario,
  coalesce(n, 0)::INT AS n_citations, b.evidence_id, b.source, b.section, b.cited AS citation_text, b.sentence AS quote, u.confidence, u.label, u.reasons,
  CASE WHEN n IS NULL THEN '地区|主体类型|贷款用途|额度|期限' ELSE array_to_string(list_filter([CASE WHEN target_entities = '' THEN '适用主体' END, CASE WHEN loan_amount_upper_limit IS NULL THEN '贷款额度' END, CASE WHEN loan_term_months IS NULL THEN '贷款期限' END, CASE WHEN interest_rate IS NULL THEN '利率' END], lambda x: x IS NOT NULL), '|') END AS missing_parameters,
  interest_rate, subsidy_rate, loan_term_months, loan_amount_upper_limit, collateral_required, guarantee_required, target_entities, usage_restrictions, repayment_constraints
FROM normal q LEFT JOIN counted USING (query_id) LEFT JOIN best b ON b.query_id = q.query_id LEFT JOIN stated s ON s.query_id = q.query_id LEFT JOIN sure u ON u.query_id = q.query_id""",
}
