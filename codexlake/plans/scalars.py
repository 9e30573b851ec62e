"""Queries over the scalar functions and predicates (P and C)."""

import re

from pyspark.sql import functions as F

from codexlake.functions import text as X
from codexlake.plans.registry import query
from codexlake.sources.views import table, view


@query("C3_collapse_newlines", "SELECT doc_id, length(regexp_replace(concat(text, chr(10), chr(10), chr(10), 'end'), '\\n{3,}', chr(10) || chr(10), 'g')) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.collapse_newlines(F.concat("text", F.lit("\n\n\nend")))).cast("bigint").alias("n"))


@query("C4_derive_title", "SELECT id, replace(split_part(path, '/', -1), '_', ' ') AS title FROM v_articles")
def _(spark, d):
    return view(spark, d, "v_articles").select("id", X.derive_title("path").alias("title"))


#: The longest start of a text within some bytes, in DuckDB.
_HEAD = "substring({0}, 1, list_max(list_filter(range(0, {1} + 1), lambda n: strlen(substring({0}, 1, n)) <= {1})))"
_SNIPPET = f"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: strlen(trim(x)) >= 50 AND NOT regexp_matches(trim(x), '^(Main article|Main topic|For other uses|Part of a series on|This article is about|Not to be confused|This list is incomplete|See also|In other)'))[1] AS line FROM documents), t AS (SELECT doc_id, text, trim(line) AS s FROM l), h AS (SELECT *, {_HEAD.format('s', 300)} AS head FROM t), u AS (SELECT *, regexp_extract(head, '^(.*[.!?])', 1, 's') AS upto FROM h) SELECT doc_id, coalesce(CASE WHEN s IS NULL THEN NULL WHEN strlen(s) <= 300 THEN s ELSE concat(rtrim(CASE WHEN upto <> '' THEN upto ELSE head END), '…') END, substring(text, 1, 200)) AS snippet FROM u"""


@query("C5_snippet", _SNIPPET)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet("text").alias("snippet"))


@query("C6_truncate", "SELECT doc_id, CASE WHEN length(text) > 400 THEN concat(substring(text, 1, 400), '…') ELSE text END AS body, length(text) > 400 AS truncated FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate("text", 400).alias("body"), X.was_truncated("text", 400).alias("truncated"))


_CUT = f"WITH h AS (SELECT doc_id, text, {_HEAD.format('text', 300)} AS head FROM documents), t AS (SELECT *, regexp_extract(head, '^(.*[.!?])', 1, 's') AS upto FROM h) SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE concat(rtrim(CASE WHEN upto <> '' THEN upto ELSE head END), '…') END AS cut FROM t"


@query("C7_truncate_at_sentence", _CUT)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sentence_cut("text", 300).alias("cut"))


@query("C8_preview", "SELECT doc_id, substring(text, 1, 2000) AS preview FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


@query("C9_extract_qid", "SELECT page_id, coalesce(list_filter(list_transform(regexp_extract_all(h, 'wikidata\\.org/wiki/Q(\\d+)#identifiers', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)[1], list_filter(list_transform(regexp_extract_all(h, 'wikidata\\.org/wiki/Q(\\d+)', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)[1]) AS qid FROM (SELECT page_id, concat(html, CASE WHEN page_id % 3 = 0 THEN concat('<a href=\"https://www.wikidata.org/wiki/Q', page_id, '#identifiers\">x</a>') WHEN page_id % 3 = 1 THEN 'wikidata.org/wiki/Q99999999999999999999 wikidata.org/wiki/Q7' ELSE '' END) AS h FROM pages)")
def _(spark, d):
    marked = F.concat("html", F.expr("CASE WHEN page_id % 3 = 0 THEN concat('<a href=\"https://www.wikidata.org/wiki/Q', page_id, '#identifiers\">x</a>') WHEN page_id % 3 = 1 THEN 'wikidata.org/wiki/Q99999999999999999999 wikidata.org/wiki/Q7' ELSE '' END"))
    return table(spark, d, "pages").select("page_id", X.entity_id(marked).alias("qid"))


@query("C10_parse_date", "WITH t AS (SELECT o_orderkey AS id, o_orderdate AS dt, o_orderkey % 8 AS k FROM orders) SELECT id, CASE WHEN k < 6 THEN CAST(dt AS DATE) END AS parsed FROM t")
def _(spark, d):
    k = "o_orderkey % 8"
    text = F.expr(f"CASE {k} WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, ' yyyy-MM-dd HH:mm:ss ') WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 3 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 4 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 5 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z') WHEN 6 THEN date_format(o_orderdate, 'MM/dd/yy') ELSE 'garbage' END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.parse_date(text).alias("parsed"))


@query("C11_base_and_version", "SELECT name, regexp_replace(name, '_[0-9]{4}-[0-9]{2}$', '') AS base, CAST(substring(regexp_extract(name, '_([0-9]{4}-[0-9]{2})$', 1), 1, 4) AS INT) AS year, CAST(substring(regexp_extract(name, '_([0-9]{4}-[0-9]{2})$', 1), 6, 2) AS INT) AS month FROM v_local")
def _(spark, d):
    v = X.version("name")
    return view(spark, d, "v_local").select("name", X.base_name("name").alias("base"), v["year"].alias("year"), v["month"].alias("month"))


@query("C12_catalog_name", "SELECT id, CASE WHEN lower(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1)) LIKE '%_.zim' THEN regexp_replace(lower(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1)), '\\.zim$', '') END AS name FROM v_transfers")
def _(spark, d):
    return view(spark, d, "v_transfers").select("id", X.catalog_name("url").alias("name"))


@query("C13_default_name", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.without_query("url").alias("bare"), X.default_name("url").alias("name"))


@query("C14_normalize_digest", "WITH t AS (SELECT doc_id, sha256(text) AS h, to_base64(unhex(sha256(CASE WHEN doc_id % 4 = 3 THEN concat(text, 'x') ELSE text END))) AS b FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE h END AS digest FROM t")
def _(spark, d):
    docs = table(spark, d, "documents")
    hexed = F.expr("CASE doc_id % 4 WHEN 0 THEN upper(sha2(text, 256)) WHEN 1 THEN 'nonsense' ELSE sha2(text, 256) END")
    coded = F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 3 THEN base64(unhex(sha2(concat(text, 'x'), 256))) ELSE base64(unhex(sha2(text, 256))) END")
    return docs.select("doc_id", X.normal_digest(hexed, coded).alias("digest"))


@query("C17_embed_text", "SELECT id, concat(coalesce(title, ''), ' ', coalesce(substring(content_preview, 1, 500), '')) AS body FROM v_articles")
def _(spark, d):
    return view(spark, d, "v_articles").select("id", X.embed_text("title", "content_preview").alias("body"))


@query("C18_eta_secs", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey * 1000) // nullif(o_orderkey % 5, 0) END AS eta, (o_orderkey % 5) * 1024 AS bps FROM orders")
def _(spark, d):
    rate = F.expr("o_orderkey % 5")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.eta_seconds(F.expr("o_custkey * 1000"), rate).alias("eta"), X.kib_to_bytes(rate).alias("bps"))


@query("C20_sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sha256_hex("text").alias("digest"))


@query("C21_display_title", "SELECT name, replace(name, '_', ' ') AS display_title FROM v_local")
def _(spark, d):
    return view(spark, d, "v_local").select("name", X.display_title("name").alias("display_title"))


@query("C23_redact_url", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('http://***@h/', page_id, '?q=a@b') ELSE concat('http://h/', page_id, '?q=a@b') END AS url FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.redact_url(F.expr("concat(CASE WHEN page_id % 2 = 0 THEN 'http://u:p@h/' ELSE 'http://h/' END, page_id, '?q=a@b')")).alias("url"))


@query("C2_head_cap", f"SELECT page_id, strlen({_HEAD.format('html', 1000)}) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.octet_length(X.byte_head("html", 1000)).cast("bigint").alias("n"))


@query("P1_scope_filter", "SELECT id, archive, language FROM v_articles WHERE archive = 'src1' AND language = 'en'")
def _(spark, d):
    from codexlake.operators.retrieval import scope_filter

    return scope_filter(view(spark, d, "v_articles"), "src1", "en").select("id", "archive", "language")


_MARKED = "concat(title_lower, CASE id % 4 WHEN 0 THEN ' 50% off' WHEN 1 THEN ' a_b' WHEN 2 THEN ' c\\\\d' ELSE ' 50x off axb' END)"


@query("P2_like_escape", f"SELECT id, contains(t, '50%') AS percent, contains(t, 'a_b') AS underscore, contains(t, 'c\\d') AS backslash, starts_with(t, 'red_') AS head FROM (SELECT id, {_MARKED.replace(chr(92) * 2, chr(92))} AS t FROM v_titles)")
def _(spark, d):
    t = view(spark, d, "v_titles").select("id", F.expr(_MARKED).alias("t"))
    return t.select("id", *[X.contains_text("t", F.lit(q)).alias(n) for q, n in (("50%", "percent"), ("a_b", "underscore"), ("c\\d", "backslash"))], X.starts_with_text("t", F.lit("red_")).alias("head"))


@query("P3_result_projection", "SELECT id, archive_id, path, title, substring(content_preview, 1, 40) AS snippet, substring(content_preview, 1, 600) AS content_preview, language, archive FROM v_articles")
def _(spark, d):
    from codexlake.operators.library import result_projection

    return result_projection(view(spark, d, "v_articles").withColumn("snippet", F.left("content_preview", F.lit(40))))


_ABOUT = "CASE id % 4 WHEN 0 THEN concat(name, '_Wiki_') ELSE name END AS name, CASE WHEN id % 3 = 0 THEN '1' || language ELSE language END AS language, CASE WHEN id % 5 = 1 THEN 'Texts of WikiPedia' END AS description, CASE WHEN id % 7 = 2 THEN 'wikipedia' ELSE 'wiki_' END AS publisher"


@query("P4_is_wiki_archive", f"SELECT id, coalesce(regexp_matches(language, '^[A-Za-z]'), false) AND (contains(lower(name), 'wikipedia') OR contains(lower(name), 'wiki_') OR contains(lower(coalesce(description, '')), 'wikipedia') OR contains(lower(coalesce(publisher, '')), 'wikipedia')) AS wiki FROM (SELECT id, {_ABOUT} FROM v_archives)")
def _(spark, d):
    about = view(spark, d, "v_archives").selectExpr("id", *re.split(r", (?=CASE)", _ABOUT))
    return about.select("id", X.is_wiki_archive("name", "language", "description", "publisher").alias("wiki"))


@query("P5_is_direct_url", "SELECT id, lower(trim(regexp_replace(url, '[?#].*$', ''))) LIKE '%.zim' AS direct FROM v_transfers")
def _(spark, d):
    return view(spark, d, "v_transfers").select("id", X.is_direct("url").alias("direct"))


@query("P6_stale_errors", "SELECT id FROM v_transfers WHERE status = 'error' AND updated_at < (SELECT max(updated_at) + INTERVAL 1 DAY FROM v_transfers) - INTERVAL 10 MINUTE AND regexp_matches(error, '(?i)connect|timeout|refused|unreachable|connection')")
def _(spark, d):
    from codexlake.operators.ledger import as_of_last, stale

    t = view(spark, d, "v_transfers")
    return stale(t, as_of_last(t), ["error"]).where(X.retryable_error("error")).select("id")


@query("P7_auth_error", "SELECT id, coalesce(regexp_matches(error, '(^|[^\\p{L}\\p{N}])(401|403)([^\\p{L}\\p{N}]|$)'), false) AS auth FROM v_transfers")
def _(spark, d):
    return view(spark, d, "v_transfers").select("id", X.access_error("error").alias("auth"))


@query("P8_active_work_count", "SELECT count(*) AS n FROM v_transfers WHERE status IN ('queued', 'seeding') OR (status = 'downloading' AND NOT lower(trim(regexp_replace(url, '[?#].*$', ''))) LIKE '%.zim') OR (status = 'cancelled' AND digest IS NOT NULL)")
def _(spark, d):
    from codexlake.operators.ledger import active_work

    return active_work(view(spark, d, "v_transfers"))


@query("P9_state_flags", "SELECT seq, progress >= 0.999 AND state IN ('uploading', 'stalledUP', 'pausedUP', 'forcedUP') AS complete, state IN ('downloading', 'forcedDL', 'stalledDL', 'metaDL', 'forcedMetaDL', 'checking', 'allocating', 'moving') AS active, state IN ('error', 'missingFiles') AS fatal FROM v_listing")
def _(spark, d):
    return view(spark, d, "v_listing").select("seq", X.is_complete("progress", "state").alias("complete"), X.is_active("state").alias("active"), X.is_fatal("state").alias("fatal"))


@query("P10_sanitize_numeric", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 100)) END AS progress, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 3.4028234663852886e38 ELSE greatest(0.0, value - 50) END AS ratio, greatest(event_id % 7 - 3, 0) AS seeds FROM events")
def _(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    r = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(1e300)).otherwise(F.col("value") - 50)
    return table(spark, d, "events").select("event_id", X.clean_fraction(v).alias("progress"), X.clean_ratio(r).alias("ratio"), X.clean_count(F.col("event_id") % 7 - 3).alias("seeds"))


@query("P11_digest_valid", "SELECT id, digest IS NULL OR regexp_matches(concat(digest, digest), '^[0-9a-f]{64}$') AS valid FROM v_transfers")
def _(spark, d):
    return view(spark, d, "v_transfers").select("id", X.digest_valid(F.concat("digest", "digest")).alias("valid"))


@query("P12_valid_name", "SELECT id, NOT (id % 3 = 0 OR id % 5 = 0) AS valid FROM v_transfers")
def _(spark, d):
    return view(spark, d, "v_transfers").select("id", X.valid_name(F.expr("CASE WHEN id % 3 = 0 THEN concat('../', name) WHEN id % 5 = 0 THEN concat('.', name) ELSE name END")).alias("valid"))


_CATEGORY = "CASE seq % 3 WHEN 0 THEN 'Books' WHEN 1 THEN 'films' END"


@query("P13_listing_candidate", f"SELECT t.id, l.seq FROM v_transfers t JOIN (SELECT *, {_CATEGORY} AS category FROM v_listing) l ON lower(t.name) = lower(l.name) WHERE lower(category) = 'books'")
def _(spark, d):
    from codexlake.operators.ledger import listing_candidates

    return listing_candidates(view(spark, d, "v_transfers"), view(spark, d, "v_listing").withColumn("category", F.expr(_CATEGORY)), "bookS")
