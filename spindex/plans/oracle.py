"""``oracle_sql()`` entries: query name -> DuckDB SQL over the driver views."""

from __future__ import annotations

from . import oracle_sql as O

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _vocab_sql() -> str:
    pc, last = O.porter_ctes("vw")
    return (f"WITH vw AS (SELECT DISTINCT unnest({O.ascii_lower_words('text')}) AS word FROM {O.DOCS}),\n"
            f"{pc}\nSELECT word, stem FROM {last}")


def _hx_stemmed() -> str:
    return (f"WITH {O.parsed_pages_ctes()},\n{O.postings_stem_ctes('pp', prefix='h')}\n"
            f"SELECT token, url, count FROM hpost")


def _topk_sql() -> str:
    return f"""WITH {O.postings_stem_ctes(O.DOCS)},
{O.query_tokens_stem_ctes()},
rel AS (SELECT * FROM post WHERE token IN (SELECT token FROM qt))
SELECT token, url, count, word_rank FROM (
  SELECT token, url, count, CAST(row_number() OVER (PARTITION BY token ORDER BY count DESC, url) AS BIGINT) AS word_rank FROM rel)
WHERE word_rank <= 50"""


def _images_sql(select: str, contexts: bool = False) -> str:
    """CTE imr (url, alt, page_url, ingest_seq, img_pos): the images put before every link; ctx
    (page_url, ingest_seq, img_pos, src, alt, context)."""
    html = ("regexp_replace(html, '<a href=\"([^\"]*)\"', "
            "'<img src=\"\\1\" alt=\"to \\1\"><a href=\"\\1\"', 'g')")
    attr = {n: O.unquoted(f"regexp_extract(tag, {O.q('(?is)' + chr(92) + 's' + n + O.VALUE)}, 1)") for n in ("src", "alt")}
    more = "" if not contexts else f""",
{O.image_span_ctes()},
ip AS (SELECT ingest_seq, i, row_number() OVER (PARTITION BY ingest_seq ORDER BY i) - 1 AS img_pos FROM ev WHERE img),
cs AS (SELECT ip.ingest_seq, ip.img_pos, arg_max(struct_pack(s := sp.s, e := sp.e), sp.o) AS b
       FROM ip LEFT JOIN sp ON sp.ingest_seq = ip.ingest_seq AND sp.o < ip.i AND ip.i < sp.c AND sp.e - sp.s > 300
       GROUP BY ip.ingest_seq, ip.img_pos),
ctx AS (SELECT page_url, imr.ingest_seq, CAST(imr.img_pos AS INTEGER) AS img_pos, imr.url AS src, alt,
               CASE WHEN b IS NULL THEN doc ELSE substr(doc, CAST(b.s + 1 AS BIGINT), CAST(b.e - b.s AS BIGINT)) END AS context
        FROM imr JOIN cs ON cs.ingest_seq = imr.ingest_seq AND cs.img_pos = imr.img_pos JOIN dl ON dl.ingest_seq = imr.ingest_seq)"""
    head = "WITH RECURSIVE" if contexts else "WITH"
    return f"""{head} {O.parsed_pages_ctes(html)},
im AS (SELECT url AS page_url, ingest_seq, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS img_pos
       FROM (SELECT url, ingest_seq, regexp_extract_all(clean, {O.q('(?is)' + O.open_tag('img'))}) AS t FROM pp)),
ia AS (SELECT page_url, ingest_seq, img_pos, {attr['src']} AS s0, {attr['alt']} AS a0 FROM im),
imr AS (SELECT page_url, ingest_seq, img_pos, {O.decode_entities('s0', True)} AS url, {O.decode_entities('a0', True)} AS alt FROM ia){more}
{select}"""


# the pages with descriptions of other shapes, two kinds of seven emptied
_VARIED_HTML = """CASE page_id % 7 WHEN 5 THEN '' WHEN 6 THEN ' ' || chr(10) || ' ' ELSE replace(html, '<title>', CASE page_id % 7
  WHEN 1 THEN '<META name="description" content="All of ' || pages.url || ' &amp; more">'
  WHEN 2 THEN '<meta content=' || chr(39) || repeat(pages.url || '  ', 9) || chr(39) || ' name=description>'
  WHEN 3 THEN '<meta name="description">'
  WHEN 4 THEN '<meta name="descriptions" content="no"><meta name="description" content="' || pages.url
    || '"><meta name="description" content="second">'
  ELSE '' END || '<title>') END"""

_IMAGE_TOKENS = """
win AS (SELECT src, arg_min(struct_pack(alt := alt, page_url := page_url, t := context || ' ' || alt), (ingest_seq, img_pos)) AS b
        FROM ctx GROUP BY src),
ww AS (SELECT src, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT src, {words} AS ws FROM win)),
{stems},
wt AS (SELECT ww.src, string_agg(stem, ' ' ORDER BY pos) AS tokens FROM ww JOIN {last} USING (word) WHERE stem NOT IN {stop} GROUP BY ww.src)
SELECT win.src AS url, b.alt AS alt, b.page_url AS page_url, coalesce(tokens, '') AS tokens FROM win LEFT JOIN wt ON wt.src = win.src"""

_IMAGE_TEXTS = "(SELECT src AS url, context || ' ' || alt AS text FROM ctx)"


def _image_tokens() -> str:
    stems, last = O.porter_ctes("(SELECT DISTINCT word FROM ww)")
    tail = _IMAGE_TOKENS.format(words=O.ascii_lower_words("b.t"), stems=stems, last=last, stop=O.STOP_LIST)
    return _images_sql("", contexts=True).rstrip() + "," + tail


def _se_images() -> str:
    lead = _images_sql("", contexts=True).removeprefix("WITH RECURSIVE ").rstrip() + ",\n"
    table = "SELECT url, arg_min(alt, (ingest_seq, img_pos)) AS alt, arg_min(page_url, (ingest_seq, img_pos)) AS page_url FROM imr GROUP BY url"
    ranked = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS BIGINT) AS rank, url, score FROM scored"
    tail = f"SELECT query_id, rank, r.url, t.alt, t.page_url, score FROM ({ranked}) r JOIN ({table}) t ON t.url = r.url"
    return O.search_sql("sum", corpus=_IMAGE_TEXTS, lead=lead, tail=tail).replace("WITH ", "WITH RECURSIVE ", 1)


def _graph_sql(select: str, recursive: bool = False, tree: bool = False) -> str:
    """``tree``: with the links from page i to pages 2i and 2i + 1."""
    host = f"lower(regexp_extract({{}}, {O.q(HOST_RE)}, 1))"
    canon = ("CASE WHEN contains(split_part({0}, '#', 1), '?') AND "
             "substr(split_part({0}, '#', 1), strpos(split_part({0}, '#', 1), '?') + 1) <> '' "
             "THEN split_part(split_part({0}, '#', 1), '?', 1) || '?' || array_to_string(list_sort(string_split("
             "substr(split_part({0}, '#', 1), strpos(split_part({0}, '#', 1), '?') + 1), '&')), '&') "
             "ELSE split_part(split_part({0}, '#', 1), '?', 1) END")
    head = "WITH RECURSIVE" if recursive else "WITH"
    more = ("\n  UNION ALL SELECT p.url, c.url, CAST(1000 + c.ingest_seq % 2 AS INTEGER) FROM rp p JOIN rp c "
            "ON p.ingest_seq = c.ingest_seq // 2 AND c.ingest_seq <> p.ingest_seq") if tree else ""
    return f"""{head} {O.parsed_pages_ctes()},
{O.links_ctes()},
ln AS (SELECT src, dst, pos FROM lk{more}),
ed AS (SELECT src, dst, pos, {O.remove_fragments('dst')} AS dst_key, {canon.format('dst')} AS canon FROM ln),
bl AS (SELECT DISTINCT dst_key AS url, src AS backlink FROM ed),
indeg AS (SELECT url, CAST(count(*) AS BIGINT) AS n FROM bl GROUP BY url),
keys AS (SELECT DISTINCT {O.remove_fragments('url')} AS node FROM pp),
fetched_canon AS (SELECT DISTINCT {canon.format('url')} AS canon FROM pp),
first_canon AS (SELECT DISTINCT {canon.format('url')} AS canon FROM pp WHERE NOT contains(url, chr(63))),
doms AS (SELECT DISTINCT {host.format('url')} AS d FROM pp),
e AS (SELECT DISTINCT {O.remove_fragments('src')} AS node, dst_key AS nxt FROM ed),
seeds AS (SELECT node FROM keys WHERE node NOT IN (SELECT nxt FROM e WHERE nxt IN (SELECT node FROM keys)))
{select}"""


def _bfs_sql(select: str, limit: str = "(SELECT count(*) FROM (SELECT node FROM keys UNION SELECT nxt FROM e))",
             seeds: str = "SELECT node FROM seeds") -> str:
    """No shortest path is longer than the number of nodes."""
    return _graph_sql(f""",
r(node, depth) AS (
    SELECT node, 0 FROM ({seeds})
    UNION
    SELECT e.nxt, r.depth + 1 FROM r JOIN e ON e.node = r.node WHERE r.depth < {limit}),
walk AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node)
""" + select, recursive=True, tree=True)


#: CTE upd: the page postings with those of pages without a query string counted twice.
_UPDATED = (f"WITH {O.parsed_pages_ctes()},\nallp AS ({O.postings_nostem('pp')}),\n"
            f"again AS ({O.postings_nostem('(SELECT * FROM pp WHERE NOT contains(url, chr(63)))')}),\n"
            "upd AS (SELECT token, url, CAST(sum(count) AS BIGINT) AS count FROM "
            "(SELECT * FROM allp UNION ALL SELECT * FROM again) GROUP BY token, url)\n")

SQL: dict[str, str] = {
    "tx_format_text": f"SELECT conv_id, turn, {O.format_text('text')} AS formatted FROM conversations",
    "tx_tokens_documents": (f"SELECT url, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens "
                            f"FROM (SELECT url, {O.tokens('text')} AS t FROM {O.DOCS})"),
    "tx_term_counts_documents": O.postings_nostem(O.DOCS),
    "tx_doc_frequency": (f"SELECT token, CAST(count(*) AS BIGINT) AS doc_freq FROM ({O.postings_nostem(O.DOCS)}) "
                         f"GROUP BY token"),
    "tx_stem_vocabulary": _vocab_sql(),
    "tx_term_counts_stemmed": f"WITH {O.postings_stem_ctes(O.DOCS)}\nSELECT token, url, count FROM post",
    "se_topk_per_word": _topk_sql(),
    "se_ranked_documents": O.search_sql("sum"),
    "se_ranked_literal": O.search_sql("literal"),
    "se_require_all": O.search_sql("sum", require_all=True),
    "se_result_pages": (f"SELECT query_id, CAST((rank - 1) // 20 AS INTEGER) AS page, CAST((rank - 1) % 20 + 1 AS INTEGER) AS place, "
                        f"url, score FROM ({O.search_sql('sum')})"),
    "hx_title_description": f"WITH {O.parsed_pages_ctes()}\nSELECT url, title, description FROM pp",
    "hx_text": f"WITH {O.parsed_pages_ctes()}\nSELECT url, text FROM pp",
    "hx_term_counts": f"WITH {O.parsed_pages_ctes()}\n{O.postings_nostem('pp')}",
    "hx_term_counts_stemmed": _hx_stemmed(),
    "hx_rejects": (f"WITH {O.parsed_pages_ctes()}\nSELECT url, 'empty document' AS reason FROM rp "
                   f"WHERE NOT regexp_matches(html, {O.NOT_BLANK})"),
    "hx_descriptions": (f"WITH {O.parsed_pages_ctes(_VARIED_HTML)}\nSELECT url, ingest_seq AS page_id, description, "
                        "CASE WHEN length(description) > 200 THEN left(description, 200) || '...' ELSE description END AS snippet FROM pp"),
    "hx_rejects_varied": (f"WITH {O.parsed_pages_ctes(_VARIED_HTML)}\nSELECT url, ingest_seq AS page_id, 'empty document' AS reason "
                          f"FROM rp WHERE NOT regexp_matches(html, {O.NOT_BLANK})"),
    "hx_links": f"WITH {O.parsed_pages_ctes()},\n{O.links_ctes()}\nSELECT src, dst, pos FROM lk",
    "ur_normalised": (f"SELECT page_id, {O.format_url('url')} AS formatted, {O.remove_fragments('url')} AS no_fragment, "
                      f"lower(regexp_extract(url, {O.q(SCHEME_RE)}, 1)) AS scheme, "
                      f"lower(regexp_extract(url, {O.q(HOST_RE)}, 1)) AS host, "
                      f"lower(regexp_extract(url, {O.q(SCHEME_RE)}, 1)) IN ('http', 'https') AS is_web FROM pages"),
    "lg_backlinks": _graph_sql("SELECT url, backlink FROM bl", tree=True),
    "lg_stubs": _graph_sql("SELECT url, n AS n_backlinks FROM indeg WHERE url NOT IN (SELECT node FROM keys)", tree=True),
    "lg_degrees": _graph_sql(
        "SELECT pp.url, coalesce(o.n, 0) AS out_degree, "
        "coalesce(i.n, 0) AS in_degree FROM pp "
        "LEFT JOIN (SELECT src, CAST(count(*) AS BIGINT) AS n FROM lk GROUP BY src) o ON o.src = pp.url "
        f"LEFT JOIN indeg i ON i.url = {O.remove_fragments('pp.url')}", tree=True),
    "lg_seen": _graph_sql("SELECT src, pos, dst, canon IN (SELECT canon FROM fetched_canon) AS seen FROM ed", tree=True),
    "lg_frontier": _graph_sql(
        "SELECT DISTINCT dst AS url FROM ed WHERE canon NOT IN (SELECT canon FROM fetched_canon) AND EXISTS ("
        f"SELECT 1 FROM doms WHERE lower(regexp_extract(ed.dst, {O.q(HOST_RE)}, 1)) = d "
        f"OR ends_with(lower(regexp_extract(ed.dst, {O.q(HOST_RE)}, 1)), '.' || d))", tree=True),
    "lg_frontier_scoped": _graph_sql(
        "SELECT DISTINCT dst AS url FROM ed WHERE canon NOT IN (SELECT canon FROM fetched_canon) AND EXISTS ("
        f"SELECT 1 FROM (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, {O.q(HOST_RE)}, 1)), '^(www|blog|m)[.]', '') AS d "
        f"FROM pp WHERE contains(url, chr(63))) WHERE lower(regexp_extract(ed.dst, {O.q(HOST_RE)}, 1)) = d "
        f"OR ends_with(lower(regexp_extract(ed.dst, {O.q(HOST_RE)}, 1)), '.' || d))", tree=True),
    "m_page_merge": _graph_sql(
        f"""SELECT coalesce(f.url, d.url) AS url, f.title, f.description, f.title IS NULL AS is_stub,
               coalesce(d.n, 0) AS n_backlinks
        FROM (SELECT {O.remove_fragments('url')} AS url, arg_min(title, ingest_seq) AS title,
                     arg_min(description, ingest_seq) AS description FROM pp GROUP BY 1) f
        FULL JOIN indeg d ON f.url = d.url"""),
    "m_insert_ignore": (f"WITH {O.parsed_pages_ctes()}\nSELECT url, CASE WHEN contains(url, '?') THEN 're-crawl: ' || title "
                        f"ELSE title END AS title, CASE WHEN contains(url, '?') THEN ingest_seq + 1000000 "
                        f"ELSE ingest_seq END AS ingest_seq FROM pp"),
    "m_postings_upsert": f"WITH {O.parsed_pages_ctes()}\n{O.postings_nostem('pp')}",
    "m_recrawl_add": (f"WITH {O.parsed_pages_ctes()},\nallp AS ({O.postings_nostem('pp')}),\n"
                      f"again AS ({O.postings_nostem('(SELECT * FROM pp WHERE NOT contains(url, chr(63)))')})\n"
                      f"SELECT token, url, CAST(sum(count) AS BIGINT) AS count FROM "
                      f"(SELECT * FROM allp UNION ALL SELECT * FROM again) GROUP BY token, url"),
    "m_recrawl_skip": f"WITH {O.parsed_pages_ctes()}\n{O.postings_nostem('pp')}",
    "m_token_url_lookup": (f"WITH {O.parsed_pages_ctes()},\nallp AS ({O.postings_nostem('pp')})\n"
                           f"SELECT token, url, count FROM allp WHERE token IN "
                           f"(SELECT unnest({O.tokens('title')}) FROM pp) AND url IN "
                           f"(SELECT url FROM pp WHERE contains(url, '?'))"),
    "m_backlink_set_add": _graph_sql("SELECT url, backlink FROM bl"),
    "st_postings_equals_batch": f"WITH {O.parsed_pages_ctes()}\n{O.postings_nostem('pp')}",
    "st_pages_first_wins": (f"WITH {O.parsed_pages_ctes()}\nSELECT arg_min(url, ingest_seq) AS url, "
                            f"arg_min(title, ingest_seq) AS title, arg_min(description, ingest_seq) AS description "
                            f"FROM pp GROUP BY {O.remove_fragments('url')}"),
    "st_first_wins_state": (f"WITH {O.parsed_pages_ctes()}\nSELECT arg_min(url, ingest_seq) AS url, "
                            f"arg_min(title, ingest_seq) AS title, arg_min(description, ingest_seq) AS description "
                            f"FROM pp GROUP BY {O.remove_fragments('url')}"),
    "st_backlinks": _graph_sql("SELECT url, backlink FROM bl"),
    "st_running_counts": f"WITH {O.parsed_pages_ctes()}\n{O.postings_nostem('pp')}",
    "scn_find": (f"WITH {O.parsed_pages_ctes()},\n{O.links_ctes()}\nSELECT url, title FROM pp WHERE "
                 f"(SELECT count(*) FROM lk WHERE lk.src = pp.url) > 5 ORDER BY url LIMIT 20 OFFSET 10"),
    "scn_count": (f"WITH {O.parsed_pages_ctes()}\nSELECT CAST(count(*) AS BIGINT) AS n FROM pp "
                  f"WHERE len(string_split(title, ' ')) > 5"),
    "scn_exists": _graph_sql("SELECT DISTINCT dst AS url, "
                             "rtrim(rtrim(dst, '/'), ' ') IN (SELECT rtrim(rtrim(url, '/'), ' ') FROM pp) AS exists FROM ln", tree=True),
    "scn_time_range": ("SELECT event_id, user_id, event_type, value FROM events "
                       "WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"),
    "scn_time_clustered": ("SELECT event_id, user_id, event_type, value FROM events "
                       "WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"),
    "scn_pages_by_backlink": _graph_sql("SELECT url, backlink FROM bl WHERE url IN (SELECT node FROM keys)", tree=True),
    "scn_forward_index": (f"WITH {O.parsed_pages_ctes()},\nallp AS ({O.postings_nostem('pp')})\n"
                          f"SELECT url, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(count) AS BIGINT) AS n_occurrences "
                          f"FROM allp GROUP BY url"),
    "scn_nested_index": (f"WITH {O.parsed_pages_ctes()},\nallp AS ({O.postings_nostem('pp')})\n"
                         f"SELECT token, substr(md5(url), 1, 2) AS part, CAST(count(*) AS BIGINT) AS n_urls, "
                         f"string_agg(url || ':' || CAST(count AS VARCHAR), ',' ORDER BY url) AS urls "
                         f"FROM allp GROUP BY 1, 2"),
    "ag_corpus_stats": _graph_sql(
        "SELECT * FROM (VALUES ('scraped', (SELECT CAST(count(*) AS BIGINT) FROM pp)), "
        "('pages', (SELECT CAST(count(*) AS BIGINT) FROM (SELECT node FROM keys UNION SELECT url FROM indeg))), "
        "('images', CAST(0 AS BIGINT)), "
        f"('page_tokens', (SELECT CAST(count(DISTINCT token) AS BIGINT) FROM ({O.postings_nostem('pp')}))), "
        "('image_tokens', CAST(0 AS BIGINT))) AS t(metric, value)"),
    "lg_seen_set": _graph_sql("SELECT src, pos, dst, canon IN (SELECT canon FROM fetched_canon) AS seen FROM ed", tree=True),
    "lg_new_targets": _graph_sql("SELECT DISTINCT dst AS url FROM ed WHERE canon NOT IN (SELECT canon FROM first_canon)", tree=True),
    "lg_depths_incremental": _bfs_sql("SELECT node AS url, depth FROM walk", seeds="SELECT node FROM keys WHERE node NOT IN (SELECT nxt FROM e)"),
    "m_store_updates": _UPDATED + "SELECT token, url, count FROM upd",
    "se_heads_under_updates": _UPDATED + (
        "SELECT token, url, count, word_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY token ORDER BY count DESC, url) "
        "AS BIGINT) AS word_rank FROM upd) WHERE word_rank <= 50"),
    "ag_doc_frequency_under_updates": _UPDATED + "SELECT token, CAST(count(*) AS BIGINT) AS doc_freq FROM upd GROUP BY token",
    "ag_store_stats": _UPDATED + (
        "SELECT 'tokens' AS metric, CAST(count(DISTINCT token) AS BIGINT) AS value FROM upd UNION ALL "
        "SELECT 'postings', CAST(count(*) AS BIGINT) FROM upd UNION ALL SELECT 'occurrences', CAST(sum(count) AS BIGINT) FROM upd "
        "UNION ALL SELECT 'urls', CAST(count(DISTINCT url) AS BIGINT) FROM upd"),
    "snk_keep_tokens": (f"WITH {O.parsed_pages_ctes()}\nSELECT url, array_to_string({O.tokens('text')}, ' ') AS tokens "
                        f"FROM pp"),
    "se_results_pages": O.results_pages_sql(),
    "hx_images": _images_sql("SELECT page_url, CAST(img_pos AS INTEGER) AS img_pos, url, alt FROM imr"),
    "m_images_insert_ignore": _images_sql(
        "SELECT url, arg_min(alt, (ingest_seq, img_pos)) AS alt, "
        "arg_min(page_url, (ingest_seq, img_pos)) AS page_url FROM imr GROUP BY url"),
    "hx_image_context": _images_sql("SELECT page_url, img_pos, src, alt, context FROM ctx", contexts=True),
    "hx_image_postings": _images_sql("SELECT token, url, count FROM ipost", contexts=True).replace(
        "\nSELECT token", ",\n" + O.postings_stem_ctes(_IMAGE_TEXTS, prefix="i") + "\nSELECT token"),
    "snk_keep_image_tokens": _image_tokens(),
    "se_images": _se_images(),
    "lg_bfs_depth": _bfs_sql("SELECT node AS url, depth FROM walk"),
    "lg_depth_limit": _bfs_sql("SELECT node AS url, depth FROM walk", limit="4"),
    "lg_depth_counts": _bfs_sql("SELECT depth, CAST(count(*) AS BIGINT) AS n FROM walk GROUP BY depth"),
}
