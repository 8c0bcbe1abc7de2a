"""SQL with the same results as the registered queries, for a second engine."""

from __future__ import annotations

#: The patterns that results depend on, in the notation of the second engine.
WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^{WS}]"
SPACED = rf"(?:{TOKEN})[{WS}]*"
FEATURE = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+"
TERM = r"[\x{3400}-\x{9fff}]{2,}|[A-Za-z0-9_]{2,}"
COMPANY = rf"(?:^|[，。；：、{WS}])([\x{{3400}}-\x{{9fff}}A-Za-z0-9·]{{2,18}}?(?:股份有限公司|有限责任公司|集团|银行|证券|保险|科技|公司))"
QUOTED = "[《“\"]([^》”\"]{3,32})[》”\"]"
DATE = r"(?i)(?:发布时间|发布日期|日期|publish(?:ed)?(?: time| date)?)[\s]*[：:][\s]*([0-9]{4}[-年/.][0-9]{1,2}[-月/.][0-9]{1,2}日?)"
BREAK = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


CHUNKS = "chunk_rows AS (SELECT DISTINCT chunk_id, doc_id, content, title, source, page_number, publish_time, chunk_index FROM chunks WHERE chunk_id IS NOT NULL)"
MERGED = """merged AS (SELECT substr(sha256(source || '|' || relation || '|' || target || '|' || chunk_id || '|' || doc_id), 1, 32) AS id, min(seq) AS seq, source, relation, target, chunk_id, doc_id,
  arg_max_null(confidence, seq) AS confidence,  coalesce((arg_min({'s': source_type, 't': target_type}, seq)).s, 'Entity') AS source_type, coalesce((arg_min({'s': source_type, 't': target_type}, seq)).t, 'Entity') AS target_type
  FROM relations WHERE source IS NOT NULL AND relation IS NOT NULL AND target IS NOT NULL AND chunk_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY source, relation, target, chunk_id, doc_id)"""
SENTENCES = f"sent AS (SELECT * FROM (SELECT chunk_id, {_strip('s')} AS sentence FROM (SELECT chunk_id, unnest(string_split_regex(content, '[。！？!?；;\\n]+')) AS s FROM chunk_rows)) WHERE sentence <> '')"
QUESTIONS = "q AS (SELECT doc_id AS query_id, title AS question FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"
TERMS = f"""words AS (SELECT query_id, question, list_transform(regexp_extract_all(question, '{TERM}'), lambda w: lower(w)) AS w FROM q),
hits AS (SELECT query_id, a.ord, unnest([lower(a.term), lower(a.canonical)]) AS term, unnest([0, 1]) AS k FROM q JOIN lexicon a ON a.kind = 'alias' AND (contains(question, a.term) OR contains(question, a.canonical))),
alls AS (SELECT query_id, term, 100000 + ord * 2 + k AS o FROM hits UNION ALL SELECT query_id, unnest(w), unnest(range(len(w))) FROM words),
terms AS (SELECT query_id, term, min(o) AS o FROM alls GROUP BY query_id, term)"""
ENDS = "names AS (SELECT DISTINCT unnest([source, target]) AS name FROM merged)"
SEEDS = "seeds AS (SELECT DISTINCT query_id, name FROM q, names WHERE contains(question, name) AND query_id IN (SELECT query_id FROM terms) UNION SELECT DISTINCT query_id, name FROM terms, names WHERE contains(lower(name), term) OR contains(term, lower(name)))"
PATH_SEEDS = "seeds AS (SELECT DISTINCT query_id, name FROM q, names WHERE contains(question, name) AND query_id IN (SELECT query_id FROM terms) UNION SELECT DISTINCT query_id, name FROM terms, names WHERE contains(lower(name), term))"


SCOPE = "scope AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM relations WHERE doc_id IS NOT NULL) ORDER BY md5(doc_id) LIMIT 100)"
ALL_ROWS = 1 << 30


def _walk(hops: int, limit: int, seeds: str = SEEDS, scoped: str = "") -> str:
    """Distances of nodes, then hops of edges, in full; the earliest of edges that differ in their document. ``scoped``: native scopes before, path after the walk."""
    parts = ["edges AS (SELECT source, target, min(seq) AS seq, arg_min(id, seq) AS id FROM merged GROUP BY source, relation, target, chunk_id)", "d0 AS (SELECT query_id, name FROM seeds)"]
    for h in range(1, hops + 1):
        parts.append(f"h{h} AS (SELECT DISTINCT query_id, seq, id, source, target FROM d{h - 1} d JOIN edges e ON d.name = e.source OR d.name = e.target)")
        parts.append(f"d{h} AS (SELECT query_id, name FROM d{h - 1} UNION SELECT query_id, unnest([source, target]) FROM h{h})")
    union = " UNION ALL ".join(f"SELECT query_id, seq, id, {h} AS hop FROM h{h}" for h in range(1, hops + 1))
    parts.append(f"reach AS (SELECT query_id, seq, id, min(hop) AS hop FROM ({union}) GROUP BY query_id, seq, id)")
    within = "WHERE id IN (SELECT id FROM merged WHERE doc_id IN (SELECT doc_id FROM scope))" if scoped == "path" else ""
    parts.append(f"placed AS (SELECT query_id, id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, seq) AS pos FROM reach {within} QUALIFY pos <= {limit})")
    merged = MERGED
    if scoped:
        merged = f"{SCOPE}, {MERGED}"
    if scoped == "native":
        merged = f"{SCOPE}, {MERGED.replace('merged AS', 'merged_all AS', 1)}, merged AS (SELECT * FROM merged_all WHERE doc_id IN (SELECT doc_id FROM scope))"
    return f"WITH {merged}, {QUESTIONS}, {TERMS}, {ENDS}, {seeds}, " + ", ".join(parts) + " SELECT query_id, CAST(pos AS INTEGER) AS pos, CAST(hop AS INTEGER) AS hop, id FROM placed"


def _topk(k: int, where: str = "") -> str:
    return f"""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
        FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 {where})) WHERE rank <= {k}"""


LISTS = f"""WITH {CHUNKS}, {MERGED}, v AS (SELECT doc_id AS query_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS rank FROM chunk_rows QUALIFY rank <= 10),
g0 AS (SELECT doc_id AS query_id, chunk_id, min(seq) AS first, max(confidence) AS score FROM merged WHERE chunk_id IN (SELECT chunk_id FROM chunk_rows) GROUP BY doc_id, chunk_id),
g AS (SELECT query_id, chunk_id, score, first, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM g0)"""
EVIDENCE = LISTS + ", ev AS (SELECT v.query_id, v.rank, c.* FROM v JOIN chunk_rows c USING (chunk_id) WHERE v.rank <= 5)"


def _first_sentence(x: str) -> str:
    plain = _strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")
    s = f"regexp_extract({plain}, '^[^。！？!?]*[。！？!?]?')"
    return f"CASE WHEN length({s}) > 180 THEN regexp_replace(substr({s}, 1, 180), '[{WS}]+$', '') || '…' ELSE {s} END"


def _spans(pattern: str, first: int, kind: str, name: str = "inner_[i]") -> str:
    """Matches of group 1 with their places: sums of the text before and of earlier matches."""
    return f"""SELECT chunk_id, sent_no, {name} AS name, {kind} AS type, list_sum(list_transform(between_[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole_[1 : i - 1], lambda x: length(x))), 0) + instr(whole_[i], inner_[i]) - 1 AS pos, {first} + i AS idx
      FROM (SELECT *, unnest(range(1, len(whole_) + 1)) AS i FROM (SELECT chunk_id, sent_no, string_split_regex(sentence, '{pattern}') AS between_, regexp_extract_all(sentence, '{pattern}') AS whole_, regexp_extract_all(sentence, '{pattern}', 1) AS inner_ FROM sn))"""


EXTRACTED = f"""WITH {CHUNKS}, parts AS (SELECT chunk_id, doc_id, title, string_split_regex(content, '[。！？!?；;\\n]+') AS p FROM chunk_rows WHERE content IS NOT NULL),
sn AS (SELECT * FROM (SELECT chunk_id, doc_id, title, i - 1 AS sent_no, {_strip('p[i]')} AS sentence FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)) WHERE sentence <> ''),
lx AS (SELECT term, CASE WHEN kind = 'industry' THEN term ELSE coalesce(canonical, term) END AS name, CASE WHEN kind = 'industry' THEN '行业' ELSE '机构' END AS type,
  CASE WHEN kind = 'industry' THEN 2000000 ELSE 0 END + row_number() OVER (PARTITION BY kind = 'industry' ORDER BY length(term) DESC, kind DESC, ord) AS idx FROM lexicon WHERE kind IN ('institution', 'alias', 'industry')),
quoted_ AS ({_spans(QUOTED, 3000000, "CASE WHEN regexp_matches(inner_[i], '意见|办法|规定|规划|通知') THEN '政策' ELSE '事件' END", _strip("inner_[i]"))}),
cand AS (SELECT chunk_id, sent_no, name, type, instr(sentence, term) - 1 AS pos, idx FROM sn JOIN lx ON contains(sentence, term) UNION ALL {_spans(COMPANY, 1000000, "'公司'")} UNION ALL SELECT * FROM quoted_ WHERE name <> ''),
ent AS (SELECT chunk_id, sent_no, name, arg_min(type, pos * 10000000 + idx) AS type, min(pos) AS pos, min(idx) AS first FROM cand GROUP BY chunk_id, sent_no, name),
e AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY chunk_id, sent_no) AS n, lead(name) OVER w AS next_name, lead(type) OVER w AS next_type FROM ent WINDOW w AS (PARTITION BY chunk_id, sent_no ORDER BY pos, first)),
r AS (SELECT chunk_id, sent_no, arg_min(canonical, ord) AS label FROM sn JOIN lexicon ON kind = 'rule' AND contains(sentence, term) GROUP BY ALL), v AS (SELECT chunk_id, sent_no, arg_min(term, ord) AS event FROM sn JOIN lexicon ON kind = 'event' AND contains(sentence, term) GROUP BY ALL),
x AS (SELECT e.*, sn.doc_id, sn.title, coalesce(label, '关联') AS label, event, CASE WHEN n >= 2 THEN n - 1 WHEN event IS NOT NULL AND event <> e.name THEN 1 ELSE 0 END AS inner_n FROM e JOIN sn USING (chunk_id, sent_no) LEFT JOIN r USING (chunk_id, sent_no) LEFT JOIN v USING (chunk_id, sent_no)),
edges AS (SELECT chunk_id, doc_id, sent_no, k - 1 AS emit_no, name AS source, label AS relation, next_name AS target, CASE WHEN label = '关联' THEN 0.55 ELSE 0.72 END AS confidence, type AS source_type, next_type AS target_type FROM x WHERE n >= 2 AND next_name IS NOT NULL
  UNION ALL SELECT chunk_id, doc_id, sent_no, 0, name, label, event, 0.62, type, '事件' FROM x WHERE n = 1 AND inner_n = 1
  UNION ALL SELECT chunk_id, doc_id, sent_no, inner_n + k - 1, name, '来源于', title, 1.0, type, '文档' FROM x WHERE title IS NOT NULL)
SELECT source, relation, target, chunk_id, arg_max(doc_id, o) AS doc_id, CAST(arg_max(confidence, o) AS DOUBLE) AS confidence, arg_max(source_type, o) AS source_type, arg_max(target_type, o) AS target_type, CAST(min(o) // 1000000 AS INTEGER) AS sent_no, CAST(min(o) % 1000000 AS INTEGER) AS emit_no
FROM (SELECT *, sent_no * 1000000 + emit_no AS o FROM edges) GROUP BY source, relation, target, chunk_id"""

CATALOG = """cat AS (SELECT doc_id, title, source, publish_time, stored_path, chunk_count, indexed_at FROM doc_catalog WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC NULLS LAST, stored_path DESC NULLS LAST, chunk_count DESC NULLS LAST, title DESC NULLS LAST, source DESC NULLS LAST, publish_time DESC NULLS LAST) = 1)"""


def _embedded(name: str, source: str) -> str:
    """Hash embedding of rows (id, text): ``name``_v with id, place and value."""
    return f"""{name}_u AS (SELECT id, list_transform(regexp_extract_all(text, '{FEATURE}'), lambda t: lower(t)) AS w FROM ({source})),
      {name}_f AS (SELECT id, sha256(unnest(w)) AS h FROM {name}_u UNION ALL SELECT id, sha256(unnest(list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1]))) FROM {name}_u WHERE len(w) > 1),
      {name}_p AS (SELECT id, CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) % 384 AS INTEGER) AS place, sum(CASE WHEN CAST('0x' || substr(h, 16, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS total FROM {name}_f GROUP BY 1, 2),
      {name}_v AS (SELECT id, place, CAST(total AS DOUBLE) / sqrt(CAST(sum(total * total) OVER (PARTITION BY id) AS DOUBLE)) AS value FROM {name}_p WHERE total <> 0)"""


def _date() -> str:
    plain = "replace(regexp_replace(trim(publish_time), '[年月/.]', '-', 'g'), '日', '')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN CAST(try_strptime({plain}, '%Y-%m-%d') AS DATE) END"


def _bonus() -> str:
    return "CASE WHEN d IS NULL THEN 0.0 ELSE 0.03 / (1 + greatest(date_diff('day', d, DATE '2026-06-01'), 0) / 365.0) END"


#: Sentences with quoted names and companies, for both engines.
SENTENCE_ROWS = [
    (1, "《上市公司分红指导意见》由中国证监会发布，华夏银行表示支持"), (2, "“绿色金融试点办法”与\"数字人民币规划\"同时公布"), (3, "没有引号的句子，只有平安保险"), (4, "《短》《  空白名称通知  》之后是《另一份文件规定》"),
    (5, "“未闭合的引号"), (6, "\"abc\"和\"ab\""), (7, "据悉，国泰君安证券、中信集团：招商银行。"), (8, "《这个名称刚好超过三十二个字符因此不应该被识别为一个引用的名称因为它实在太长了》"), (9, "《内有“嵌套”引号》"),
]


def values() -> str:
    return ", ".join(f"({i}, '{s}')" for i, s in SENTENCE_ROWS)


def _answers(mode: str, cited: bool = False) -> str:
    """Answers from five pieces of evidence a question, of the vector list, the graph list or both."""
    vector = f"""{_embedded('qe', 'SELECT query_id AS id, question AS text FROM q')}, {_embedded('ce', 'SELECT chunk_id AS id, content AS text FROM chunk_rows WHERE content IS NOT NULL')},
      vl AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.id AS query_id, b.id AS chunk_id, round(sum(a.value * b.value), 12) AS score FROM qe_v a JOIN ce_v b USING (place) GROUP BY 1, 2) QUALIFY rank <= {10 if mode == "hybrid" else 5})"""
    graph = """gl0 AS (SELECT query_id, chunk_id, min(pos) AS first, max(confidence) AS score FROM placed JOIN merged USING (id) WHERE chunk_id IN (SELECT chunk_id FROM chunk_rows WHERE content IS NOT NULL) GROUP BY query_id, chunk_id),
      gl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM gl0)"""
    fused = """u AS (SELECT query_id, chunk_id, rank, 0 AS turn, 1.0 AS w FROM vl UNION ALL SELECT query_id, chunk_id, rank, 1, 0.9 FROM gl),
      fu AS (SELECT query_id, chunk_id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS score, min(turn * 1000000000 + rank) AS place FROM u GROUP BY query_id, chunk_id), l AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, place) AS rank FROM fu)"""
    if cited:
        bonus = f"coalesce((SELECT bonus FROM bonuses WHERE bonuses.chunk_id = vl.chunk_id), 0)"
        ranked = {"vector": f"{vector}, l AS (SELECT query_id, chunk_id, rank, score + {bonus} AS score FROM vl)", "hybrid": f"{vector}, {graph}, {fused.replace('AS rank FROM fu', 'AS rank, score FROM fu')}"}[mode]
        walk = _walk(2, 30).split(" SELECT query_id, CAST(pos", 1)[0]
        dated = f"bonuses AS (SELECT chunk_id, {_bonus()} AS bonus FROM (SELECT chunk_id, {_date()} AS d FROM chunk_rows))"
        return f"{walk}, {CHUNKS}, {dated}, {ranked} SELECT query_id, CAST(rank AS INTEGER) AS number, chunk_id, round(score, 6) AS score, title FROM l JOIN chunk_rows USING (chunk_id) WHERE rank <= 5"
    parts = {"vector": f"{vector}, l AS (SELECT * FROM vl)", "graph": f"{graph}, l AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, first) AS rank FROM gl)", "hybrid": f"{vector}, {graph}, {fused}"}[mode]
    walk = _walk(2, 30).split(" SELECT query_id, CAST(pos", 1)[0]
    return f"""{walk}, {CHUNKS}, {parts}, s AS (SELECT query_id, rank, {_first_sentence("coalesce(content, '')")} AS s FROM l JOIN chunk_rows USING (chunk_id) WHERE rank <= 3),
      a AS (SELECT query_id, '根据当前知识库，可以得到以下信息：' || chr(10) || coalesce(string_agg('- ' || s || '[证据' || rank || ']' || chr(10), '' ORDER BY rank) FILTER (WHERE s <> ''), '') || chr(10) || '以上结论仅依据已索引材料，请结合原文发布日期和完整上下文核验。' AS answer FROM s GROUP BY query_id)
      SELECT query_id, question, coalesce(answer, '当前知识库没有检索到足够证据，暂时无法给出可靠结论。') AS answer FROM q LEFT JOIN a USING (query_id)"""


def statements() -> dict[str, str]:
    embed = f"""WITH u AS (SELECT doc_id, list_transform(regexp_extract_all(title, '{FEATURE}'), lambda t: lower(t)) AS w FROM documents WHERE title IS NOT NULL),
      f AS (SELECT doc_id, unnest(w) AS feature FROM u UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1])) FROM u WHERE len(w) > 1)"""
    block = """'[证据' || rank || ']' || chr(10) || '标题：' || coalesce(title, '') || chr(10) || '来源：' || coalesce(source, '') || chr(10) || '发布日期：' || coalesce(nullif(publish_time, ''), '未提供') || chr(10) || '页码：' || coalesce(CAST(nullif(page_number, 0) AS VARCHAR), '无') || chr(10) || '内容：' || coalesce(content, '')"""
    style = """CASE entity_type WHEN '公司' THEN '#2563eb' WHEN '机构' THEN '#7c3aed' WHEN '行业' THEN '#059669' WHEN '政策' THEN '#dc2626' WHEN '事件' THEN '#d97706' WHEN '文档' THEN '#64748b' ELSE '#0891b2' END"""
    plain_date = "replace(regexp_replace(trim(publish_time), '[年月/.]', '-', 'g'), '日', '')"
    out = {
        "text_documents": "SELECT substr(sha256(text), 1, 24) AS doc_id, title, title AS source, publish_time, CAST(1 AS INTEGER) AS page_number, CAST(length(text) AS INTEGER) AS chars, 'text' AS file_type FROM documents WHERE text IS NOT NULL",
        "labelled_dates": f"SELECT doc_id, nullif(regexp_extract(text, '{DATE}', 1), '') AS labelled FROM documents",
        "guessed_titles": f"""SELECT doc_id, coalesce(list_filter(list_transform(string_split_regex(replace(text, chr(0), ''), '{BREAK}'), lambda x: {_strip(f"regexp_replace({_strip('x')}, '^#+', '')")}),
          lambda y: length(y) BETWEEN 4 AND 100 AND NOT starts_with(y, '来源：') AND NOT starts_with(y, '日期：'))[1], doc_key) AS guess FROM documents WHERE text IS NOT NULL""",
        "token_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL",
        "chunk_texts": f"""WITH t AS (SELECT doc_key AS doc_id, regexp_extract_all(text, '{SPACED}') AS tok FROM documents WHERE text IS NOT NULL),
          w AS (SELECT doc_id, tok, unnest(range(CAST(CASE WHEN len(tok) <= 128 THEN 1 ELSE ceil((len(tok) - 128) / 96.0) + 1 END AS BIGINT))) AS i FROM t WHERE len(tok) > 0),
          c AS (SELECT doc_id, i, regexp_replace(array_to_string(tok[i * 96 + 1 : i * 96 + 128], ''), '[{WS}]+$', '') AS content FROM w)
          SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(sha256(doc_id || ':1:' || i || ':' || content), 1, 24) AS chunk_id, CAST(length(content) AS INTEGER) AS chars FROM c""",
        "chunk_pages": f"""WITH p AS (SELECT DISTINCT * FROM parsed_pages WHERE text IS NOT NULL), t AS (SELECT doc_id, page_number, page_id, regexp_extract_all(text, '{SPACED}') AS tok FROM p),
          k AS (SELECT *, CAST(CASE WHEN len(tok) <= 256 THEN 1 ELSE ceil((len(tok) - 256) / 192.0) + 1 END AS BIGINT) AS n FROM t WHERE len(tok) > 0),
          o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_number NULLS FIRST, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM k),
          w AS (SELECT *, unnest(range(n)) AS i FROM o), c AS (SELECT doc_id, page_number, CAST(first + i AS INTEGER) AS chunk_index, regexp_replace(array_to_string(tok[i * 192 + 1 : i * 192 + 256], ''), '[{WS}]+$', '') AS content FROM w)
          SELECT doc_id, CAST(page_number AS VARCHAR) AS page_number, chunk_index, substr(sha256(doc_id || ':' || coalesce(CAST(page_number AS VARCHAR), 'None') || ':' || chunk_index || ':' || content), 1, 24) AS chunk_id FROM c""",
        "unsearchable": f"SELECT doc_key AS doc_id FROM documents WHERE text IS NULL OR len(regexp_extract_all(text, '{TOKEN}')) = 0",
        "feature_totals": f"{embed} SELECT feature, count(*) AS n FROM f GROUP BY feature",
        "hash_embedding": f"""{embed}, p AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(feature), 1, 15) AS BIGINT) % 384 AS INTEGER) AS place, sum(CASE WHEN CAST('0x' || substr(sha256(feature), 16, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS total FROM f GROUP BY 1, 2)
          SELECT doc_id, place, round(CAST(total AS DOUBLE) / sqrt(CAST(sum(total * total) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS value FROM p WHERE total <> 0""",
        "cosine_topk": """SELECT chunk_id, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT e.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
          FROM embeddings q, embeddings e WHERE q.vec_id = 0 ORDER BY score DESC, chunk_id LIMIT 10)""",
        "cosine_batch": _topk(10),
        "cosine_scoped": _topk(5, "AND e.label IN (1, 4)"),
        "chunk_lookup": f"WITH {CHUNKS} SELECT r.seq AS pos, chunk_id, c.doc_id, c.chunk_index FROM relations r JOIN chunk_rows c USING (chunk_id) WHERE r.seq % 100 = 0",
        "vector_upsert": """SELECT vec_id + 100 AS chunk_id, -1 AS doc_id, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS n FROM embeddings WHERE vec_id % 3 = 0
          UNION ALL SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6), CAST(len(embedding) AS INTEGER) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id + 100 FROM embeddings WHERE vec_id % 3 = 0)""",
        "sentence_split": f"WITH s AS (SELECT doc_id, {_strip('x')} AS sentence FROM (SELECT doc_id, unnest(string_split_regex(text, '[。！？!?；;\\n]+')) AS x FROM documents WHERE text IS NOT NULL)) SELECT doc_id, count(*) AS n, CAST(max(length(sentence)) AS INTEGER) AS longest FROM s WHERE sentence <> '' GROUP BY doc_id",
        "lexicon_mentions": f"""WITH {CHUNKS}, {SENTENCES}, l AS (SELECT term, CASE WHEN kind = 'industry' THEN term ELSE coalesce(canonical, term) END AS name FROM lexicon WHERE kind IN ('institution', 'alias', 'industry'))
          SELECT name, count(*) AS n, CAST(sum(instr(sentence, term) - 1) AS BIGINT) AS places FROM sent, l WHERE contains(sentence, term) GROUP BY name""",
        "company_names": f"WITH {CHUNKS}, {SENTENCES} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(sentence, '{COMPANY}', 1)) AS name FROM sent) GROUP BY name",
        "quoted_names": f"WITH {CHUNKS}, {SENTENCES} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(sentence, '{QUOTED}', 1)) AS name FROM sent) GROUP BY name",
        "relation_labels": f"""WITH {CHUNKS}, {SENTENCES}, n AS (SELECT row_number() OVER () AS k, sentence FROM sent),
          r AS (SELECT k, arg_min(canonical, ord) AS label FROM n, lexicon WHERE kind = 'rule' AND contains(sentence, term) GROUP BY k), e AS (SELECT k, arg_min(term, ord) AS event FROM n, lexicon WHERE kind = 'event' AND contains(sentence, term) GROUP BY k)
          SELECT coalesce(label, '关联') AS label, event, count(*) AS n FROM n LEFT JOIN r USING (k) LEFT JOIN e USING (k) GROUP BY 1, 2""",
        "extracted_relations": EXTRACTED,
        "merged_relations": f"WITH {MERGED} SELECT id, seq, confidence, source_type, target_type FROM merged",
        "graph_entities": f"WITH {MERGED} SELECT source AS name, source_type AS entity_type FROM merged UNION SELECT target, target_type FROM merged",
        "graph_counts": f"WITH {MERGED} SELECT (SELECT count(*) FROM (SELECT source, source_type FROM merged UNION SELECT target, target_type FROM merged)) AS entities, (SELECT count(*) FROM merged) AS relations",
        "question_terms": f"WITH {QUESTIONS}, {TERMS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS at, term FROM terms",
        "graph_seeds": f"WITH {MERGED}, {QUESTIONS}, {TERMS}, {ENDS}, {SEEDS} SELECT query_id, name FROM seeds",
        "graph_one_hop": _walk(1, 30),
        "graph_two_hops": _walk(2, 30),
        "graph_limit": _walk(2, 3),
        "graph_fallback": f"""WITH {MERGED}, q AS (SELECT CAST(ord AS BIGINT) AS query_id, '？' || term || '？' AS question FROM lexicon WHERE kind = 'rule'), {TERMS}, {ENDS}, {SEEDS},
          edges AS (SELECT source, relation, target, chunk_id, min(seq) AS seq, arg_min(id, seq) AS id FROM merged GROUP BY ALL), h1 AS (SELECT DISTINCT query_id, seq, id, source, target FROM seeds d JOIN edges e ON d.name = e.source OR d.name = e.target),
          d1 AS (SELECT query_id, name FROM seeds UNION SELECT query_id, unnest([source, target]) FROM h1), h2 AS (SELECT DISTINCT query_id, seq, id FROM d1 d JOIN edges e ON d.name = e.source OR d.name = e.target),
          reach AS (SELECT query_id, seq, id, min(hop) AS hop FROM (SELECT query_id, seq, id, 1 AS hop FROM h1 UNION ALL SELECT query_id, seq, id, 2 FROM h2) GROUP BY ALL
            UNION ALL SELECT DISTINCT t.query_id, m.seq, m.id, 0 FROM terms t JOIN merged m ON contains(lower(m.relation), t.term) WHERE t.query_id NOT IN (SELECT query_id FROM seeds))
          SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS pos, CAST(hop AS INTEGER) AS hop, id FROM reach WINDOW w AS (PARTITION BY query_id ORDER BY hop, seq) QUALIFY row_number() OVER w <= 30""",
        "graph_path_dialect": _walk(2, 30, PATH_SEEDS),
        "simple_edges": f"WITH {MERGED} SELECT source, target, arg_max_null(relation, seq) AS relation, arg_max_null(confidence, seq) AS confidence FROM merged GROUP BY source, target",
        "node_styles": f"""WITH {MERGED}, s AS (SELECT DISTINCT source, target FROM merged), d AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM s UNION ALL SELECT target FROM s) GROUP BY name),
          t AS (SELECT name, arg_max(kind, seq * 2 + turn) AS entity_type FROM (SELECT source AS name, source_type AS kind, seq, 0 AS turn FROM merged UNION ALL SELECT target, target_type, seq, 1 FROM merged) GROUP BY name)
          SELECT name, entity_type, CAST(degree AS INTEGER) AS degree, CAST(least(48, 20 + 4 * degree) AS INTEGER) AS size, CASE WHEN length(name) <= 12 THEN name ELSE substr(name, 1, 11) || '…' END AS label, {style} AS colour FROM d JOIN t USING (name)""",
        "date_bonus": f"""SELECT doc_id, round(CASE WHEN d IS NULL THEN 0.0 ELSE 0.03 / (1 + greatest(date_diff('day', d, DATE '2026-06-01'), 0) / 365.0) END, 9) AS bonus
          FROM (SELECT doc_id, CASE WHEN regexp_full_match({plain_date}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN CAST(try_strptime({plain_date}, '%Y-%m-%d') AS DATE) END AS d FROM documents)""",
        "graph_channel": f"{LISTS} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM g",
        "graph_evidence": f"{LISTS} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, first) AS INTEGER) AS rank, round(score, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, first) <= 5",
        "rank_fusion": f"""{LISTS}, u AS (SELECT query_id, chunk_id, rank, 'vector' AS ch, 0 AS turn, 1.0 AS w FROM v UNION ALL SELECT query_id, chunk_id, rank, 'graph', 1, 0.9 FROM g),
          f AS (SELECT query_id, chunk_id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS score, min(turn * 1000000000 + rank) AS place, array_to_string(list_sort(list(DISTINCT ch)), '+') AS channel FROM u GROUP BY query_id, chunk_id)
          SELECT query_id, chunk_id, channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, place) AS INTEGER) AS rank, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, place) <= 5""",
        "citations": f"{EVIDENCE} SELECT query_id, CAST(rank AS INTEGER) AS number, chunk_id, title, source, CAST(page_number AS VARCHAR) AS page_number, round(1.0 / rank, 6) AS score, CASE WHEN length(content) > 220 THEN substr(content, 1, 220) || '…' ELSE content END AS excerpt FROM ev",
        "first_sentences": f"SELECT doc_id, {_first_sentence('text')} AS sentence FROM documents WHERE text IS NOT NULL",
        "prompt_texts": f"""{EVIDENCE}, b AS (SELECT query_id, string_agg({block}, chr(10) || chr(10) ORDER BY rank) AS body, count(*) AS n FROM ev GROUP BY query_id),
          r AS (SELECT query_id, string_agg(line, chr(10) ORDER BY seq) AS lines FROM (SELECT doc_id AS query_id, seq, source || ' --' || relation || '--> ' || target AS line FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) <= 30) GROUP BY query_id)
          SELECT query_id, CAST(n AS INTEGER) AS n_evidence, md5('用户问题：' || query_id || chr(10) || chr(10) || '文本证据：' || chr(10) || body || chr(10) || chr(10) || '图谱关系：' || chr(10) || coalesce(lines, '无') || chr(10) || chr(10) || '请直接给出答案，并按规则引用证据。') AS prompt_md5 FROM b LEFT JOIN r USING (query_id)""",
        "extractive_answers": f"""{EVIDENCE}, s AS (SELECT query_id, rank, {_first_sentence("coalesce(content, '')")} AS s FROM ev WHERE rank <= 3)
          SELECT query_id, '根据当前知识库，可以得到以下信息：' || chr(10) || coalesce(string_agg('- ' || s || '[证据' || rank || ']' || chr(10), '' ORDER BY rank) FILTER (WHERE s <> ''), '') || chr(10) || '以上结论仅依据已索引材料，请结合原文发布日期和完整上下文核验。' AS answer FROM s GROUP BY query_id""",
        "answers_vector": _answers("vector"),
        "answers_graph": _answers("graph"),
        "answers_hybrid": _answers("hybrid"),
        "evidence_vector": _answers("vector", True),
        "evidence_hybrid": _answers("hybrid", True),
        "refused": "SELECT CAST(n_nationkey AS BIGINT) AS query_id, '!' || (n_nationkey % 10) AS question, '当前知识库没有检索到足够证据，暂时无法给出可靠结论。' AS answer FROM nation",
        "graph_scoped": _walk(2, 30, scoped="native"),
        "graph_path_scoped": _walk(2, 30, PATH_SEEDS, "path"),
        "quoted_examples": f"SELECT id, name, kind FROM (SELECT id, unnest(regexp_extract_all(sentence, '{QUOTED}', 1)) AS name, 'quoted' AS kind FROM (VALUES {values()}) t(id, sentence) UNION ALL SELECT id, unnest(regexp_extract_all(sentence, '{COMPANY}', 1)), 'company' FROM (VALUES {values()}) t(id, sentence))",
        "parsed_files": f"""WITH f AS (SELECT doc_id AS k, translate(text, '<>&', '') AS t, text FROM documents WHERE text IS NOT NULL),
          r AS (SELECT 'd' || k || '.txt' AS source, 'txt' AS file_type, text AS raw, replace(text, chr(0), '') AS page FROM f WHERE k % 3 = 0
            UNION ALL SELECT 'd' || k || '.html', 'html', '<div><p>' || t || '</p> <b>end</b></div>', CASE WHEN {_strip('t')} = '' THEN 'end' ELSE {_strip('t')} || chr(10) || 'end' END FROM f WHERE k % 3 = 1
            UNION ALL SELECT 'd' || k || '.csv', 'csv', '"' || replace(text, '"', '""') || '", x', {_strip('text')} || ' | x' FROM f WHERE k % 3 = 2)
          SELECT substr(sha256(raw), 1, 24) AS doc_id, source, file_type, CAST(length(page) AS INTEGER) AS chars, md5(page) AS page FROM r""",
        "catalog_rows": f"WITH {CATALOG} SELECT * FROM cat",
        "catalog_listing": f"WITH {CATALOG} SELECT doc_id, indexed_at, chunk_count FROM cat",
        "catalog_display": f"WITH {CATALOG} SELECT doc_id, title, source, coalesce(publish_time, '') AS publish_time, chunk_count, coalesce(title, '') || ' · ' || substr(doc_id, 1, 8) AS choice FROM cat",
        "catalog_get": f"WITH {CATALOG} SELECT doc_id, title, chunk_count FROM cat WHERE doc_id = (SELECT min(doc_key) FROM documents)",
        "engine_stats": f"""WITH {CATALOG}, {MERGED} SELECT (SELECT count(*) FROM cat) AS documents, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks, (SELECT count(*) FROM (SELECT source, source_type FROM merged UNION SELECT target, target_type FROM merged)) AS entities, (SELECT count(*) FROM merged) AS relations""",
        "payload_codec": f"WITH {CHUNKS} SELECT chunk_id, doc_id, md5(content) AS content, title, source, CAST(page_number AS VARCHAR) AS page_number, publish_time, chunk_index FROM chunk_rows",
    }
    whole = {"rank_fusion": " QUALIFY rank <= 10", "citations": " WHERE v.rank <= 5", "prompt_texts": " WHERE v.rank <= 5", "extractive_answers": " WHERE v.rank <= 5", "chunk_lookup": " WHERE r.seq % 100 = 0"}
    out |= {f"{name}_all": out[name].replace(cut, "").replace(" QUALIFY rank <= 10)", ")") for name, cut in whole.items()}
    contents = f"WITH {CHUNKS}, {_embedded('ce', 'SELECT chunk_id AS id, content AS text FROM chunk_rows WHERE content IS NOT NULL')}"
    out["content_embedding"] = f"{contents} SELECT id AS chunk_id, place, round(value, 6) AS value FROM ce_v"
    out["content_features"] = f"{contents} SELECT feature, count(*) AS n FROM (SELECT unnest(w) AS feature FROM ce_u UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1])) FROM ce_u WHERE len(w) > 1) GROUP BY feature"
    return out
