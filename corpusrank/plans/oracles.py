"""DuckDB SQL for the rows of the catalog's queries, and the literals that both sides share."""

from __future__ import annotations

from ..functions.urls import ERROR_ENDINGS, HIDDEN_PARTS, PENALTY_PARTS, SOURCE_ENDINGS

WORKLOAD = ["the and", "that is the", "is was for this", "the", "the of the", "die der und", "le la les de", "que de la", "machine learning", "!!!", "zzzz the", "in to be of and", "copyright license", "software engineering of"]
LOOKUP = ("the", "der", "que", "and", "zzzz")
SNIPPETS = (("example.com", "Commercial"), ("example.org", "Organisation"))

#: Statistics of the search index: documents' unstemmed words; N counts all rows.
_TOK = "tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS toks FROM documents)"
_POS = _TOK + ", pos AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS term FROM tok)"
_TF = _POS + ", tf AS (SELECT doc_id, term, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM pos GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(WORKLOAD)) + ") AS v(query_id, query)), qt AS (SELECT query_id, list_transform(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: lower(x)) AS terms FROM q), qx AS (SELECT query_id, len(terms) AS qn, unnest(range(len(terms))) AS i, unnest(terms) AS term FROM qt)"
_MAIN = (
    "hit AS (SELECT query_id, qn, i, doc_id, (1 + ln(tf)) * ln(n / df) AS s, ps FROM qx JOIN tf USING (term) JOIN df USING (term), n), "
    "least AS (SELECT query_id, doc_id, min(ps[1]) AS m FROM hit GROUP BY ALL), "
    "main AS (SELECT query_id, doc_id, sum(s) AS base, min(i) AS first, max(qn) AS qn, count(*) FILTER (i >= 1 AND len(list_filter(ps, lambda p: abs(p - m - i) <= 5)) > 0) AS h FROM hit JOIN least USING (query_id, doc_id) GROUP BY query_id, doc_id), "
    "near AS (SELECT query_id, doc_id, base, first, CASE WHEN qn > 1 THEN 1 + 0.3::DOUBLE * h + CASE WHEN h = qn - 1 THEN 0.5::DOUBLE ELSE 0 END ELSE 1 END AS nearness FROM main)"
)
_NG = "ng AS (" + " UNION ALL ".join(f"SELECT {n} AS n, doc_id, unnest(list_transform(range(greatest(0, len(toks) - {n - 1})), lambda k: array_to_string(toks[k + 1 : k + {n}], '_'))) AS gram FROM tok" for n in (2, 3)) + ")"
_QG = "qg AS (" + " UNION ALL ".join(f"SELECT {n} AS n, query_id, unnest(list_transform(range(greatest(0, len(terms) - {n - 1})), lambda k: array_to_string(terms[k + 1 : k + {n}], '_'))) AS gram FROM qt" for n in (2, 3)) + ")"
_GRAM = _NG + ", " + _QG + ", occ AS (SELECT n, gram, doc_id, count(*) AS occ FROM ng GROUP BY ALL), cf AS (SELECT n, gram, sum(occ) AS cf FROM occ GROUP BY ALL), gs AS (SELECT query_id, doc_id, sum(0.3::DOUBLE * occ * ln((SELECT n FROM n) / cf)) AS score FROM qg JOIN occ USING (n, gram) JOIN cf USING (n, gram) GROUP BY ALL)"
_UNION = "un AS (SELECT query_id, doc_id, sum(score) AS score, min(first) AS first FROM (SELECT query_id, doc_id, base * nearness AS score, first FROM near UNION ALL SELECT query_id, doc_id, score, NULL FROM gs) GROUP BY ALL)"


def _like(parts: tuple[str, ...], ends: bool = False, what: str = "low") -> str:
    test = "ends_with" if ends else "contains"
    return "(" + " OR ".join(f"{test}({what}, '{p}')" for p in parts) + ")"


_APACHE = "(contains(low, 'apache') AND (contains(low, 'server') OR contains(low, 'port')))"
_SOURCE = _like(SOURCE_ENDINGS, True, "split_part(low, '?', 1)")
_HIDE = f"(low = '' OR {_like(HIDDEN_PARTS)} OR {_like(ERROR_ENDINGS, True)} OR {_APACHE} OR {_SOURCE} OR (contains(low, '/~') AND {_like(tuple('/' + e for e in SOURCE_ENDINGS), True)}))"
_LOW = "low AS (SELECT page_id, url, lower(coalesce(url, '')) AS low FROM pages)"
_URLS = "u AS (SELECT doc_id, 'http://' || source || '.example.org/' || CASE WHEN doc_id % 3 = 0 THEN 'page/' ELSE 'doc/' END || CAST(doc_id // 2 AS VARCHAR) AS url FROM documents), vis AS (SELECT doc_id, url FROM (SELECT *, lower(url) AS low FROM u) WHERE NOT " + _HIDE + ")"
_BEST = "best AS (SELECT query_id, url, doc_id, round(score, 6) AS score, first, row_number() OVER (PARTITION BY query_id, url ORDER BY round(score, 6) DESC, first, doc_id) AS r FROM un JOIN vis USING (doc_id))"
_SEARCH = ", ".join((_TF, _Q, _MAIN, _GRAM, _UNION, _URLS, _BEST))

_PLAIN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '<', 'g'), '(?s)<!--.*?-->|<![^>]*>', '<', 'g'), '<[^<>]*>|<|&[a-z]+;', ' ', 'g')"
_ANCHORS = "an AS (SELECT page_id AS doc_id, unnest(list_transform(flatten(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda a: regexp_extract_all(a, '[A-Za-z0-9]+'))), lambda x: lower(x))) AS term FROM pages), anc AS (SELECT doc_id, term, count(*) AS tf FROM an GROUP BY ALL)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_E3 = "nd AS (SELECT doc_id, (SELECT count(*) FROM documents) AS n FROM documents), ed AS (SELECT DISTINCT doc_id AS src, (doc_id * 7 + 3) % n AS dst FROM nd UNION SELECT doc_id, (doc_id * 13 + 1) % n FROM nd), od AS (SELECT src, count(*) AS od FROM ed GROUP BY src)"


#: Steps after which the test graphs have surely converged.
CONVERGED = 24


def _pr(steps: int, kept: str = "") -> str:
    out = [f"p0 AS {kept}(SELECT doc_id, 1.0::DOUBLE / n AS pr FROM nd)"]
    for k in range(steps):
        out.append(f"p{k + 1} AS {kept}(SELECT nd.doc_id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * coalesce(s, 0) AS pr FROM nd LEFT JOIN (SELECT dst, sum(pr / od) AS s FROM ed JOIN od USING (src) JOIN p{k} ON src = doc_id GROUP BY dst) ON dst = nd.doc_id)")
    return ", ".join(out)


def _hits(steps: int) -> str:
    out = ["h0 AS (SELECT doc_id, 1.0::DOUBLE AS hub FROM nd)"]
    for k in range(steps):
        out.append(f"ra{k} AS (SELECT nd.doc_id, coalesce(s, 0) AS x FROM nd LEFT JOIN (SELECT dst, sum(hub) AS s FROM ed JOIN h{k} ON src = doc_id GROUP BY dst) ON dst = nd.doc_id)")
        out.append(f"a{k + 1} AS (SELECT doc_id, x / (SELECT sqrt(sum(x * x)) FROM ra{k}) AS authority FROM ra{k})")
        out.append(f"rh{k} AS (SELECT nd.doc_id, coalesce(s, 0) AS x FROM nd LEFT JOIN (SELECT src, sum(authority) AS s FROM ed JOIN a{k + 1} ON dst = doc_id GROUP BY src) ON src = nd.doc_id)")
        out.append(f"h{k + 1} AS (SELECT doc_id, x / (SELECT sqrt(sum(x * x)) FROM rh{k}) AS hub FROM rh{k})")
    return ", ".join(out)


_BITS = ", ".join(f"sum(tf * (2 * CAST((h >> {i}) & 1 AS BIGINT) - 1)) AS v{i}" for i in range(64))
_BITSUM = " + ".join(f"CASE WHEN v{i} > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
_SIM = _TF + f", hs AS (SELECT doc_id, tf, ('0x' || substr(md5(term), 17, 16))::UBIGINT AS h FROM tf), vo AS (SELECT doc_id, {_BITS} FROM hs GROUP BY doc_id), sim AS (SELECT doc_id, CAST({_BITSUM} AS UBIGINT) AS f FROM vo)"
_WORDS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"

#: Pages as tags and texts, and the open elements before each of them.
_OPEN = """RECURSIVE src AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '<>', 'g'), '(?s)<!--.*?-->|<![^>]*>', '<>', 'g'), '&[a-z]+;', ' ', 'g'), '<[^<>]*>|[^<]+') AS toks FROM pages),
w AS (SELECT page_id, 1 AS i, toks, CAST([] AS VARCHAR[]) AS stack FROM src
 UNION ALL SELECT page_id, i + 1, toks, CASE WHEN name = '' OR name IN ('br', 'hr', 'img', 'input', 'link', 'meta', 'wbr') THEN stack
  WHEN toks[i] LIKE '</%' THEN CASE WHEN list_contains(stack, name) THEN stack[1 : len(stack) - list_position(list_reverse(stack), name)] ELSE stack END
  ELSE list_append(stack, name) END
 FROM (SELECT *, lower(regexp_extract(toks[i], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM w WHERE i <= len(toks)))"""

_IN = "len(list_filter(stack, lambda x: x IN ({0}))) AS {1}"
#: Distinct pages as an unstemmed index: the same tables as of documents, with emphasised words and link words.
_PAGE_TF = (
    _OPEN + ", kept AS (SELECT page_id, split_part(url, '#', 1) AS url, row_number() OVER (ORDER BY page_id) - 1 AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(html, '')) ORDER BY page_id) AS r FROM pages) WHERE r = 1), "
    "words AS (SELECT doc_id, i, generate_subscripts(l, 1) AS j, lower(unnest(l)) AS term, b, a FROM (SELECT doc_id, i, regexp_extract_all(toks[i], '[A-Za-z0-9]+') AS l, " + _IN.format("'h1', 'h2', 'h3', 'b', 'strong', 'title'", "b") + ", " + _IN.format("'a'", "a") + " FROM w JOIN kept USING (page_id) WHERE i <= len(toks) AND toks[i] NOT LIKE '<%')), "
    "imp AS (SELECT doc_id, term, sum(b) AS itf FROM words GROUP BY ALL), anc AS (SELECT doc_id, term, sum(a) AS tf FROM words WHERE a > 0 GROUP BY ALL), adf AS (SELECT term, count(*) AS df FROM anc GROUP BY term), "
    "tok AS (SELECT doc_id, list(term ORDER BY i, j) AS toks FROM words GROUP BY doc_id)" + _TF.removeprefix(_TOK).replace("FROM documents", "FROM kept")
)
_PAGE_SEARCH = ", ".join((_PAGE_TF, _Q, _MAIN, _GRAM)) + (
    ", em AS (SELECT query_id, doc_id, 1 + 0.5::DOUBLE * sum(itf) AS emphasis FROM qx JOIN imp USING (term) GROUP BY ALL), "
    "an AS (SELECT query_id, doc_id, sum(1.5::DOUBLE * (1 + ln(tf)) * ln(n / df)) AS score FROM qx JOIN anc USING (term) JOIN adf USING (term), n GROUP BY ALL), "
    "un AS (SELECT query_id, doc_id, sum(score) * (1 + 2.5::DOUBLE * (1 - 0.85::DOUBLE) / max(n)) AS score, min(first) AS first FROM (SELECT query_id, doc_id, base * emphasis * nearness AS score, first FROM near JOIN em USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, score, NULL FROM gs UNION ALL SELECT query_id, doc_id, score, NULL FROM an), n GROUP BY query_id, doc_id), "
    "vis AS (SELECT doc_id, url FROM (SELECT *, lower(url) AS low FROM kept) WHERE NOT " + _HIDE + "), " + _BEST
)

SQL: dict[str, str] = {
    "tokenize_positions": f"WITH {_POS} SELECT doc_id, pos, term FROM pos",
    "term_frequency": f"WITH {_TF} SELECT doc_id, term, tf FROM tf",
    "doc_frequency": f"WITH {_TF} SELECT term, df, round(ln(n / df), 6) AS idf FROM df, n",
    "position_map": f"WITH {_TF} SELECT doc_id, term, array_to_string(ps, ',') AS positions FROM tf",
    "postings_list": f"WITH {_TF} SELECT term, doc_id // 65536 AS part, count(*) AS docs, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM tf GROUP BY 1, 2",
    "empty_documents": f"WITH {_TF} SELECT doc_id, len(toks) AS n_tokens, CAST(coalesce(s, 0) AS BIGINT) AS posted FROM tok LEFT JOIN (SELECT doc_id, sum(tf) AS s FROM tf GROUP BY doc_id) USING (doc_id)",
    "page_defaults": "SELECT path, CASE WHEN page_id % 3 > 0 THEN coalesce(url, path) ELSE path END AS url, md5(CASE WHEN page_id % 5 > 0 THEN coalesce(html, '') ELSE '' END) AS content_md5 FROM (SELECT *, 'in/' || page_id || '.json' AS path FROM pages)",
    "query_file": "SELECT doc_id, CAST(i - 1 AS BIGINT) AS query_id, query FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS query FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM documents)) WHERE query <> ''",
    "result_formats": "SELECT doc_id, CASE WHEN n_chars / 700.0::DOUBLE < 1 THEN '< 1' ELSE printf('%.0f', n_chars / 700.0::DOUBLE) END AS time, printf('%.2f', n_chars / 7.0::DOUBLE) AS score FROM documents",
    "vocab_stats": f"WITH {_TF} SELECT (SELECT n FROM n) AS num_documents, count(DISTINCT term) AS num_unique_terms, CAST(sum(tf) AS BIGINT) AS num_tokens FROM tf",
    "bigram_cf": f"WITH {_TOK}, {_NG} SELECT gram, count(*) AS cf FROM ng WHERE n = 2 GROUP BY gram",
    "trigram_cf": f"WITH {_TOK}, {_NG} SELECT gram, count(*) AS cf FROM ng WHERE n = 3 GROUP BY gram",
    "posting_lookup": f"WITH {_TF} SELECT term, doc_id, tf, df FROM tf JOIN df USING (term) WHERE term IN {LOOKUP}",
    "md5_hash": "SELECT doc_id, md5(coalesce(text, '')) AS content_md5 FROM documents",
    "exact_dedup": "SELECT min(doc_id) AS doc_id, md5(coalesce(text, '')) AS content_md5 FROM documents GROUP BY 2",
    "exact_dup_groups": "SELECT md5(coalesce(text, '')) AS content_md5, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "exact_dup_members": "SELECT doc_id, content_md5, first FROM (SELECT doc_id, md5(coalesce(text, '')) AS content_md5, count(*) OVER w AS c, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY md5(coalesce(text, '')))) WHERE c > 1",
    "dense_doc_ids": "SELECT d AS source_id, row_number() OVER (ORDER BY d) - 1 AS doc_id FROM (SELECT min(doc_id) AS d FROM documents GROUP BY md5(coalesce(text, '')))",
    "simhash64": f"WITH {_SIM} SELECT doc_id, lpad(lower(to_hex(f)), 16, '0') AS simhash FROM sim",
    "near_duplicates": f"WITH {_SIM}, cl AS (SELECT f, min(doc_id) AS id FROM sim GROUP BY f) SELECT a.id AS doc_id, b.id AS dup_id, CAST(bit_count(CAST(xor(a.f, b.f) AS UBIGINT)) AS INTEGER) AS hamming FROM cl a JOIN cl b ON a.id < b.id AND bit_count(CAST(xor(a.f, b.f) AS UBIGINT)) <= 3",
    "near_duplicate_classes": f"WITH {_SIM} SELECT doc_id, lpad(lower(to_hex(f)), 16, '0') AS simhash, min(doc_id) OVER (PARTITION BY f) AS class_id FROM sim",
    "url_defragment": "SELECT page_id, split_part(url, '#', 1) AS url FROM pages",
    "url_hidden": f"WITH {_LOW} SELECT page_id, {_HIDE} AS hidden FROM low",
    "url_penalty": f"WITH {_LOW} SELECT page_id, pow(0.001::DOUBLE, {_like(PENALTY_PARTS)}::INT + {_like(ERROR_ENDINGS, True)}::INT + {_APACHE}::INT + {_SOURCE}::INT) AS penalty FROM low",
    "url_title": f"""WITH p AS (SELECT page_id, url, {_HOST} AS host, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS seg FROM pages),
c AS (SELECT *, regexp_replace(host, '^(.*?)www\\.', '\\1') AS bare, list_filter(list_transform(seg, lambda s: trim(regexp_replace(translate(s, '-_', '  '), '\\.(html|php|htm|aspx|asp)$', '', 'i'))), lambda s: length(s) > 1 AND NOT regexp_full_match(s, '[0-9]+')) AS ok FROM p),
d AS (SELECT *, string_split(bare, '.') AS lab FROM c)
SELECT page_id, CASE WHEN host = '' THEN url WHEN len(seg) = 0 THEN bare WHEN len(ok) > 0 THEN {_WORDS.format("ok[-1]")} WHEN len(lab) > 1 THEN {_WORDS.format("lab[-2]")} || ' - ' || upper(lab[-1]) ELSE bare END AS title FROM d""",
    "display_url": f"WITH p AS (SELECT page_id, CASE WHEN {_HOST} = '' THEN url ELSE {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END END AS d FROM pages) SELECT page_id, CASE WHEN length(d) > 80 THEN d[1:80] || '...' ELSE d END AS display_url, CASE WHEN length(d) > 30 THEN d[1:30] || '...' ELSE d END AS short_url FROM p",
    "url_snippet": f"SELECT page_id, CASE {' '.join(f'''WHEN contains({_HOST}, '{a}') THEN '{b}' ''' for a, b in SNIPPETS)} ELSE 'Click to view this page' END AS snippet FROM pages",
    "html_extract": f"SELECT page_id AS doc_id, array_to_string(list_transform(regexp_extract_all({_PLAIN}, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ') AS tokens FROM pages",
    "important_terms": f"WITH {_OPEN}, words AS (SELECT page_id, unnest(regexp_extract_all(toks[i], '[A-Za-z0-9]+')) AS word, len(list_filter(stack, lambda x: x IN ('h1', 'h2', 'h3', 'b', 'strong', 'title'))) AS n FROM w WHERE i <= len(toks) AND toks[i] NOT LIKE '<%') SELECT page_id AS doc_id, lower(word) AS term, CAST(sum(n) AS BIGINT) AS important_tf FROM words WHERE n > 0 GROUP BY ALL",
    "anchor_terms": f"WITH {_ANCHORS} SELECT doc_id, term, tf FROM anc",
    "page_hrefs": "WITH h AS (SELECT page_id AS doc_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT doc_id, root || split_part(href, '#', 1) AS target FROM h WHERE href <> ''",
    "term_multiplicity": f"WITH {_Q} SELECT CAST(query_id AS BIGINT) AS query_id, term, count(*) AS qtf FROM qx GROUP BY ALL",
    "tfidf_topk": f"WITH {_TF}, {_Q}, {_MAIN}, r AS (SELECT query_id, doc_id, round(base, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(base, 6) DESC, first, doc_id) AS r FROM near) SELECT CAST(query_id AS BIGINT) AS query_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM r WHERE r <= 10",
    "proximity_boost": f"WITH {_TF}, {_Q}, {_MAIN} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(nearness, 6) AS nearness FROM near",
    "ngram_score": f"WITH {_TOK}, n AS (SELECT count(*) AS n FROM documents), {_Q}, {_GRAM} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score FROM gs",
    "anchor_score": f"WITH {_Q}, {_ANCHORS}, n AS (SELECT count(*) AS n FROM pages), df AS (SELECT term, count(*) AS df FROM anc GROUP BY term) SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(sum(1.5::DOUBLE * (1 + ln(tf)) * ln(n / df)), 6) AS score FROM qx JOIN anc USING (term) JOIN df USING (term), n GROUP BY ALL",
    "score_union": f"WITH {_TF}, {_Q}, {_MAIN}, {_GRAM}, {_UNION} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(first AS INTEGER) AS first FROM un",
    "rank_boosts": f"WITH {_E3}, {_pr(1)}, {_hits(1)} SELECT nd.doc_id, round((1.0::DOUBLE + nd.doc_id % 10) * (1 + 2.5::DOUBLE * pr) * (1 + 1.5::DOUBLE * authority), 6) AS score FROM nd JOIN p1 USING (doc_id) JOIN a1 USING (doc_id)",
    "dup_demotion": "WITH s AS (SELECT doc_id, 1.0::DOUBLE + doc_id % 7 AS score, count(*) OVER w AS c, max(1.0::DOUBLE + doc_id % 7) OVER w AS best FROM documents WINDOW w AS (PARTITION BY md5(coalesce(text, '')))) SELECT doc_id, round(CASE WHEN c > 1 AND score < 0.9::DOUBLE * best THEN score * 0.1::DOUBLE ELSE score END, 6) AS score FROM s",
    "url_result_dedup": f"WITH {_SEARCH} SELECT CAST(query_id AS BIGINT) AS query_id, url, doc_id FROM best WHERE r = 1",
    "total_count": f"WITH {_SEARCH} SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS total_count FROM best WHERE r = 1 GROUP BY 1",
    "search_batch": f"WITH {_SEARCH}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rn, count(*) OVER (PARTITION BY query_id) AS total_count FROM best WHERE r = 1) SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rn AS INTEGER) AS rank, doc_id, url, score, total_count FROM o WHERE rn <= 10",
    "emphasis_factor": f"WITH {_PAGE_SEARCH} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, emphasis FROM near JOIN em USING (query_id, doc_id)",
    "search_pages_plain": f"WITH {_PAGE_SEARCH}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rn, count(*) OVER (PARTITION BY query_id) AS total_count FROM best WHERE r = 1) SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rn AS INTEGER) AS rank, doc_id, url, score, total_count FROM o WHERE rn <= 10",
    "index_statistics": "WITH k AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))) SELECT (SELECT count(*) FROM k) AS num_documents, count(DISTINCT term) AS num_unique_terms, 0.0::DOUBLE AS index_size_kb FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM documents JOIN k USING (doc_id))",
    "asof_links": "SELECT src, max(doc_id) AS dst FROM (SELECT page_id AS src, (page_id * 7 + 3) % 50 AS u FROM pages) JOIN (SELECT page_id AS doc_id, page_id % 50 AS u FROM pages) USING (u) WHERE doc_id <= src GROUP BY src",
    "corpus_links": "SELECT src, max(doc_id) AS dst FROM (SELECT page_id AS src, (page_id * 7 + 3) % 50 AS u FROM pages) JOIN (SELECT page_id AS doc_id, page_id % 50 AS u FROM pages) USING (u) GROUP BY src",
    "out_degree": "SELECT o_custkey AS src, count(DISTINCT l_suppkey) AS out_degree FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "pagerank_k5": f"WITH {_E3}, {_pr(5)} SELECT doc_id, round(pr, 12) AS pr FROM p5",
    "pagerank_converged": f"WITH {_E3}, {_pr(CONVERGED, 'MATERIALIZED ')}, gone AS ({' UNION ALL '.join(f'SELECT {k} AS k, sum(abs(a.pr - b.pr)) AS l1 FROM p{k} a JOIN p{k - 1} b USING (doc_id)' for k in range(1, CONVERGED + 1))}), every AS ({' UNION ALL '.join(f'SELECT {k} AS k, * FROM p{k}' for k in range(1, CONVERGED + 1))}) SELECT doc_id, round(pr, 9) AS pr FROM every WHERE k = (SELECT min(k) FROM gone WHERE l1 < 1e-6)",
    "hits_k5": f"WITH {_E3}, {_hits(5)} SELECT doc_id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h5 JOIN a5 USING (doc_id)",
    "l1_convergence": f"WITH {_E3}, {_pr(2)} SELECT round(sum(abs(p2.pr - p1.pr)), 9) AS l1 FROM p1 JOIN p2 USING (doc_id)",
    "l2_norm": "SELECT round(sqrt(sum((n_chars / 1000.0::DOUBLE) * (n_chars / 1000.0::DOUBLE))), 6) AS norm FROM documents",
}
