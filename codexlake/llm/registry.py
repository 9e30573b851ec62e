"""Queries over the operators of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexlake.llm import embeddings, extraction, fingerprints, jaccard, packing, pieces, quality, scoring, sharding, toxicity, variants, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_warc": warc.op2_warc,
        "op3_embeddings": embeddings.op3_embeddings,
        "op4_packing": packing.op4_packing,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_pieces": pieces.op7_pieces,
        "op8_scoring": scoring.op8_scoring,
        "op9_quality": quality.op9_quality,
        "op10_sharding": sharding.op10_sharding,
        "op11_variants": variants.op11_variants,
        "op12_whitening": whitening.op12_whitening,
        "op13_extraction": extraction.op13_extraction,
    }


#: Records that revisit another name the largest page_id of their payload; the digest's 160 bits are spelled five hex digits, four letters, at a time.
_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, strlen(body) AS payload_bytes, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substring(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS groups FROM d),
s AS (SELECT *, list_transform(flatten(list_transform(groups, lambda g: [g // 32768, g // 1024 % 32, g // 32 % 32, g % 32])), lambda v: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INT), 1)) AS letters FROM b)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM s"""

#: Links between all pairs, then the least node that is reached.
_REACH = "r AS (SELECT DISTINCT a AS node, a AS seen FROM links UNION SELECT r.node, links.b FROM r JOIN links ON links.a = r.seen), c AS (SELECT node, least(node, min(seen)) AS low FROM r GROUP BY node)"

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id"""

_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
z AS (SELECT doc_id, len(sh) AS n FROM s), t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM t x JOIN t y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)), {_REACH}
SELECT z.doc_id, n AS n_shingles, coalesce(low, z.doc_id) AS component_id FROM z LEFT JOIN c ON c.node = z.doc_id"""

#: crc32 of bytes by its table of 256 steps; near words share what is left without one place, or one is what is left of the other.
_VARIANTS = """WITH RECURSIVE table_of AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, n, doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda k: CAST('0x' || substring(x, CAST(2 * k + 1 AS INT), 2) AS BIGINT))), lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295) AS h FROM d, table_of),
c AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) + 2 AS INT)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, k, substring(word, 1, CAST(k AS INT)) || substring(word, CAST(k + 2 AS INT)) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM w)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.rest UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.rest),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM pairs),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN ranked ON ranked.word = w.word AND place = 1),
way AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT way.word, f.word, f.form FROM way JOIN f ON f.word = way.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN way ON way.word = f.word AND next IS NULL"""

#: The given pages name their article; there the cut keeps just that element.
_EXTRACTION = """WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""


def oracle_sql() -> dict[str, str]:
    """SQL of the results that SQL can express; the others' methods (sketches, models, packing, permutations) are held against plain versions in the tests."""
    return {"op2_warc": _WARC, "op3_embeddings": _VECTORS, "op5_jaccard": _JACCARD, "op11_variants": _VARIANTS, "op13_extraction": _EXTRACTION}
