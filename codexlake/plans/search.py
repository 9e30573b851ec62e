"""Queries over the retrieval operators (T, M)."""

from pyspark.sql import functions as F

from codexlake.cluster import scratch
from codexlake.functions.text import similarity, trigrams
from codexlake.operators import lookup as L
from codexlake.operators import retrieval as R
from codexlake.operators.grams import open_gram_index, write_gram_index
from codexlake.operators.library import set_difference
from codexlake.plans.registry import query
from codexlake.sources.views import table, view

#: Trigrams, similarity and tokens in DuckDB.
_GRAMS = "list_distinct(flatten(list_transform(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: concat('  ', w, ' ')), lambda p: list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)))))"
_SIM = "len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h)))"
_TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_POST = f"post AS (SELECT id, unnest({_TOK.format('title')}) AS token, 1.0 AS w FROM v_articles UNION ALL SELECT id, unnest({_TOK.format('content_preview')}), 0.4 FROM v_articles)"
_TITLES = f"tt AS (SELECT id, title_lower, {_GRAMS.format('title_lower')} AS g, qq.q, {_GRAMS.format('qq.q')} AS h FROM v_titles, (SELECT 'red widget' AS q) qq), ts AS (SELECT *, CAST({_SIM} AS DOUBLE) AS sim FROM tt)"


def _q(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id bigint, q string")


@query("T1_postings", f"WITH {_POST} SELECT token, id, CAST(w AS DOUBLE) AS weight, count(*) AS n FROM post GROUP BY ALL")
def _(spark, d):
    return R.postings(view(spark, d, "v_articles")).select("token", "id", "weight", F.size("positions").cast("bigint").alias("n"))


#: Places of all tokens in title and preview, and which documents hold a phrase.
_POS = f"tk AS (SELECT id, {_TOK.format('title')} AS t, {_TOK.format('content_preview')} AS p FROM v_articles), pos AS (SELECT id, unnest(t) AS token, CAST(1.0 AS DOUBLE) AS w, unnest(range(len(t))) AS spot FROM tk UNION ALL SELECT id, unnest(p), CAST(0.4 AS DOUBLE), unnest(range(len(t), len(t) + len(p))) FROM tk)"
_TEXT = "concat(' ', array_to_string(t, ' '), ' ', array_to_string(p, ' '), ' ')"


def _has(phrase):
    return f"contains({_TEXT}, ' {phrase} ')"


#: Queries in the language of full-text search, and the condition in SQL that each means.
_ASKED = {
    "the of -with": f"{_has('the')} AND {_has('of')} AND NOT {_has('with')}", '"of the"': _has("of the"), "der or que": f"{_has('der')} OR {_has('que')}", "of-the": _has("of the"),
    'the "of the" or die -der': f"({_has('the')} AND {_has('of the')}) OR ({_has('die')} AND NOT {_has('der')})", 'the -"of the"': f"{_has('the')} AND NOT {_has('of the')}",
}


@query("T2_fts_match", f"WITH {_POS} " + " UNION ALL ".join(f"SELECT {k} AS query_id, id FROM tk WHERE {c}" for k, c in enumerate(_ASKED.values())))
def _(spark, d):
    return R.fts_match(_q(spark, *_ASKED), R.postings(view(spark, d, "v_articles"))).select(F.col("query_id").cast("int").alias("query_id"), "id")


@query("T2_phrase", "SELECT CAST(0 AS BIGINT) AS query_id, id FROM v_articles WHERE contains(concat(' ', array_to_string(" + _TOK.format("title") + ", ' '), ' ', array_to_string(" + _TOK.format("content_preview") + ", ' '), ' '), ' of the ')")
def _(spark, d):
    return R.phrase_match(_q(spark, "of the"), R.postings(view(spark, d, "v_articles")))


@query("T3_fts_rank", f"WITH {_POST}, s AS (SELECT token, id, 0.6 * sum(w) AS score FROM post WHERE token IN ('the', 'der', 'que') GROUP BY token, id), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, id) AS rank FROM s) SELECT CASE token WHEN 'the' THEN 0 WHEN 'der' THEN 1 ELSE 2 END AS query_id, id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM r WHERE rank <= 10")
def _(spark, d):
    found = R.fts_match(_q(spark, "the", "der", "que"), R.postings(view(spark, d, "v_articles"))).withColumn("score", F.round(F.col("score") * 0.6, 6))
    return R.top_k(found, 10, "fts").select(F.col("query_id").cast("int").alias("query_id"), "id", "score", F.col("arm_pos").cast("bigint").alias("rank"))


#: Of a query of two words the covers are neighbouring hits of different words.
_COVER = "l AS (SELECT q.query_id, pos.*, lag(pos.token) OVER o AS lt, lag(w) OVER o AS lw, lag(spot) OVER o AS la FROM pos JOIN q ON q.token = pos.token WINDOW o AS (PARTITION BY q.query_id, id ORDER BY spot)), s AS (SELECT query_id, id, round(sum(2 / (1 / w + 1 / lw) / (spot - la)), 9) AS score FROM l WHERE lt <> token GROUP BY query_id, id)"


@query("T3_cover_rank", f"WITH {_POS}, q AS (SELECT unnest([0, 0, 1, 1]) AS query_id, unnest(['the', 'of', 'der', 'die']) AS token), {_COVER}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def _(spark, d):
    found = R.cover_rank(_q(spark, "the of", "der die"), R.postings(view(spark, d, "v_articles"))).withColumn("score", F.round("score", 9))
    return R.top_k(found, 20, "fts").select(F.col("query_id").cast("int").alias("query_id"), "id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("rank"))


@query("T4_highlight")
def _(spark, d):
    # headlines are made for the ranked rows only
    a = view(spark, d, "v_articles")
    best = R.top_k(R.fts_match(_q(spark, "the"), R.postings(a)), 20, "fts").select("id")
    return a.join(best, "id").select("id", R.highlight(F.col("content_preview"), "the").alias("headline"))


@query("T5_prefix_arm", f"WITH {_TITLES.replace('red widget', 'red')}, r AS (SELECT id, round(0.4 * sim, 6) AS score, row_number() OVER (ORDER BY 0.4 * sim DESC, id) AS rank FROM ts WHERE starts_with(title_lower, q)) SELECT id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 50")
def _(spark, d):
    return R.prefix_arm(_q(spark, "red"), view(spark, d, "v_titles"), 50).select("id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("rank"))


@query("T6_contains_arm", f"WITH {_TITLES.replace('red widget', 'widget')}, r AS (SELECT id, round(0.4 * sim, 6) AS score, row_number() OVER (ORDER BY 0.4 * sim DESC, id) AS rank FROM ts WHERE contains(title_lower, q)) SELECT id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 50")
def _(spark, d):
    return R.contains_arm(_q(spark, "widget"), view(spark, d, "v_titles"), 50).select("id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("rank"))


@query("T7_similarity_arm", f"WITH {_TITLES} SELECT id, CAST(round(sim, 6) AS DOUBLE) AS sim FROM ts WHERE sim > 0.3")
def _(spark, d):
    return R.similar_titles(_q(spark, "red widget"), view(spark, d, "v_titles")).select("id", F.round("sim", 6).alias("sim"))


_BATCH = f"q AS (SELECT id AS query_id, title_lower AS q, {_GRAMS.format('title_lower')} AS h FROM v_titles WHERE id % 100 = 0), t AS (SELECT id, title_lower, {_GRAMS.format('title_lower')} AS g FROM v_titles), s AS (SELECT query_id, id, q, title_lower, CAST({_SIM} AS DOUBLE) AS sim FROM q, t)"


@query("T7_similarity_batch", f"WITH {_BATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.4 * sim, 9) DESC, id) AS rank FROM s WHERE sim > 0.3) SELECT query_id, id, CAST(round(0.4 * sim, 6) AS DOUBLE) AS score, rank FROM r WHERE rank <= 10")
def _(spark, d):
    # every hundredth title is a query against all titles
    t = view(spark, d, "v_titles")
    q = t.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("title_lower").alias("q"))
    return R.similarity_arm(q, t, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("rank"))


_PREMERGED = f"WITH {_BATCH}, a AS (SELECT *, 0 AS o FROM s WHERE starts_with(title_lower, q) UNION ALL SELECT *, 1 FROM s WHERE contains(title_lower, q) AND length(q) >= 3 UNION ALL SELECT *, 2 FROM s WHERE sim > 0.3), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, o ORDER BY round(0.4 * sim, 9) DESC, id) AS p FROM a), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY o, p) AS r FROM p WHERE p <= 10) SELECT query_id, id, CAST(round(0.4 * sim, 6) AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY o, p) AS pos FROM u WHERE r = 1"


@query("M2_premerge_batch", _PREMERGED)
def _(spark, d):
    t = view(spark, d, "v_titles")
    q = t.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("title_lower").alias("q"))
    return R.trigram_arms(q, t, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("pos"))


@query("M2_premerge_index", _PREMERGED)
def _(spark, d):
    # the same batch over stored grams
    t = view(spark, d, "v_titles")
    path = scratch(spark, "grams")
    write_gram_index(t, path)
    q = t.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("title_lower").alias("q"))
    return R.trigram_arms(q, open_gram_index(spark, path), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("pos"))


@query("T8_trigram_similarity", f"WITH {_TITLES} SELECT id, CAST(round(sim, 6) AS DOUBLE) AS sim FROM ts")
def _(spark, d):
    return view(spark, d, "v_titles").select("id", F.round(similarity(trigrams("title_lower"), trigrams(F.lit("red widget"))), 6).alias("sim"))


_VEC = "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e) AS sim FROM v_vectors v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS k FROM s) SELECT query_id, id, CAST(round(0.5 * greatest(sim, 0), 6) AS DOUBLE) AS score FROM r WHERE k <= 10"


@query("T9_vector_arm", _VEC.replace("v_vectors v", "(SELECT vec_id AS id, embedding FROM embeddings) v"))
def _(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_arm(q, _all_vectors(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"))


def _all_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("T10_vector_arm_ann")
def _(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # indexed whatever the size
    return R.vector_arm_ann(q, _all_vectors(spark, d), 10, from_rows=1)


@query("T11_arm_gate", "SELECT p_partkey AS query_id, m = 'fts' AND l OR m = 'hybrid' AND l AS run_fts, m IN ('trgm', 'hybrid') OR NOT l AS run_prefix, m IN ('trgm', 'hybrid') AND l AS run_long, m IN ('vector', 'hybrid') AND l AS run_vec FROM (SELECT p_partkey, length(substring(p_name, 1, p_partkey % 5 + 1)) >= 3 AS l, CASE p_partkey % 4 WHEN 0 THEN 'fts' WHEN 1 THEN 'trgm' WHEN 2 THEN 'vector' ELSE 'hybrid' END AS m FROM part)")
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.expr("left(p_name, int(p_partkey % 5 + 1))").alias("q"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'fts' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'semantic' ELSE 'other' END").alias("mode"))
    return R.arm_gate(q).select("query_id", "run_fts", "run_prefix", "run_long", "run_vec")


@query("T12_fetch_budget", "SELECT p_partkey AS query_id, l AS limit, o AS offset, least(l + o, 5500) AS fetch, least(least(l + o, 5500) * CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 2 END, 5500) AS vec_fetch FROM (SELECT p_partkey, least(p_size, 50) AS l, least(p_partkey * 7, 5000) AS o FROM part)")
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_size").alias("limit"), (F.col("p_partkey") * 7).alias("offset"), (F.col("p_partkey") % 2 == 0).alias("filtered"))
    return R.fetch_budget(q).select("query_id", "limit", "offset", "fetch", "vec_fetch")


@query("T13_query_vector_lookup", "SELECT p.p_partkey AS query_id, e.vec_id IS NOT NULL AS cached FROM part p LEFT JOIN embeddings e ON concat('m|64|', trim(p.p_partkey::VARCHAR)) = concat('m|64|', e.vec_id)")
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" ")).alias("q"))
    v = table(spark, d, "embeddings").select(F.lit("m").alias("model"), F.lit(64).alias("size"), F.col("vec_id").cast("string").alias("q"), F.col("embedding").alias("vector"))
    return R.with_vectors(q, v, "m", 64).select("query_id", F.col("vector").isNotNull().alias("cached"))


_ARMS = f"{_TITLES}, pre AS (SELECT id, 0.4 * sim AS score, row_number() OVER (ORDER BY sim DESC, id) AS p FROM ts WHERE starts_with(title_lower, q)), con AS (SELECT id, 0.4 * sim AS score, row_number() OVER (ORDER BY sim DESC, id) AS p FROM ts WHERE contains(title_lower, q)), sim AS (SELECT id, 0.4 * sim AS score, row_number() OVER (ORDER BY sim DESC, id) AS p FROM ts WHERE sim > 0.3), u AS (SELECT id, score, 0 AS o, p FROM pre WHERE p <= 40 UNION ALL SELECT id, score, 1, p FROM con WHERE p <= 40 UNION ALL SELECT id, score, 2, p FROM sim WHERE p <= 40), one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, p) AS r FROM u), trg AS (SELECT id, score, row_number() OVER (ORDER BY o, p) AS pos FROM one WHERE r = 1)"


@query("M2_premerge_trgm", f"WITH {_ARMS} SELECT id, CAST(round(score, 6) AS DOUBLE) AS score, pos FROM trg")
def _(spark, d):
    return R.trigram_arms(_q(spark, "red widget"), view(spark, d, "v_titles"), 40).select("id", F.round("score", 6).alias("score"), F.col("arm_pos").cast("bigint").alias("pos"))


@query("M1_merge_arms", f"WITH {_ARMS}, near AS (SELECT e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) o), vec AS (SELECT id, round(0.5 * greatest(c, 0), 9) AS score, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS pos FROM near QUALIFY pos <= 200), a AS (SELECT id, score, 1 AS arm, pos FROM trg UNION ALL SELECT id, score, 2, pos FROM vec), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, arm, pos) AS r FROM a) SELECT id, CAST(round(score, 6) AS DOUBLE) AS score, CASE arm WHEN 1 THEN 'trgm' ELSE 'vector' END AS arm FROM f WHERE r = 1")
def _(spark, d):
    t = view(spark, d, "v_titles")
    trgm = R.trigram_arms(_q(spark, "red widget"), t, 40).withColumn("score", F.round("score", 9))
    asked = table(spark, d, "embeddings").where("vec_id = 1").select(F.lit(0).cast("bigint").alias("query_id"), F.col("embedding").alias("q"))
    vec = R.vector_arm(asked, _all_vectors(spark, d), 200).withColumn("score", F.round("score", 9))
    return R.merge_arms(trgm, vec).select("id", F.round("score", 6).alias("score"), "arm")


@query("M3_hybrid_search", f"WITH {_POST}, att AS (SELECT id, lower(title) AS title_lower, {_GRAMS.format('title')} AS g, {_GRAMS.format(chr(39) + 'the' + chr(39))} AS h FROM v_articles), sm AS (SELECT id, title_lower, CASE WHEN len(g) = 0 THEN 0 ELSE CAST({_SIM} AS DOUBLE) END AS sim FROM att), fts AS (SELECT id, 0.6 * sum(w) AS score, row_number() OVER (ORDER BY sum(w) DESC, id) AS pos FROM post WHERE token = 'the' GROUP BY id), pre AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS p FROM sm WHERE starts_with(title_lower, 'the')), con AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS p FROM sm WHERE contains(title_lower, 'the')), si AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS p FROM sm WHERE sim > 0.3), u AS (SELECT id, 0.4 * sim AS score, 0 AS o, p FROM pre WHERE p <= 20 UNION ALL SELECT id, 0.4 * sim, 1, p FROM con WHERE p <= 20 UNION ALL SELECT id, 0.4 * sim, 2, p FROM si WHERE p <= 20), one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, p) AS r FROM u), trg AS (SELECT id, score, 1 AS arm, row_number() OVER (ORDER BY o, p) AS pos FROM one WHERE r = 1), al AS (SELECT id, score, 0 AS arm, pos FROM fts WHERE pos <= 20 UNION ALL SELECT id, score, arm, pos FROM trg), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, arm, pos) AS r FROM al), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, arm, pos) AS rank FROM f WHERE r = 1) SELECT id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM k WHERE rank > 10 AND rank <= 20")
def _(spark, d):
    a = view(spark, d, "v_articles")
    return R.hybrid_search(_q(spark, "the"), a, R.postings(a), limit=10, offset=10).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _hybrid_sql(words, archive, limit, offset, vector):
    """Hybrid search of two words in one archive with the vector of a vec_id, as SQL."""
    q = " ".join(words)
    fetch = limit + offset
    grams = _GRAMS.format("title_lower")
    near = f"nn AS (SELECT e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vector}) o), nk AS (SELECT *, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS k FROM nn), v0 AS (SELECT nk.id, 0.5 * greatest(c, 0) AS score, row_number() OVER (ORDER BY round(0.5 * greatest(c, 0), 9) DESC, nk.id) AS p FROM nk JOIN sc ON sc.id = nk.id WHERE k <= {4 * fetch}), vec AS (SELECT id, score, p FROM v0)"
    arm = "SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS p FROM sm"
    return (
        f"WITH {_POS}, sc AS (SELECT id FROM v_articles WHERE archive = '{archive}'), q AS (SELECT 0 AS query_id, unnest(['{words[0]}', '{words[1]}']) AS token), {_COVER}, "
        f"fts AS (SELECT s.id, round(0.6 * score, 9) AS score, row_number() OVER (ORDER BY round(0.6 * score, 9) DESC, s.id) AS p FROM s JOIN sc ON sc.id = s.id), "
        f"ti AS (SELECT id, lower(title) AS title_lower FROM v_articles WHERE archive = '{archive}'), gm AS (SELECT id, title_lower, {grams} AS g, {_GRAMS.format(chr(39) + q + chr(39))} AS h FROM ti), sm AS (SELECT id, title_lower, 0.4 * CASE WHEN len(g) = 0 THEN 0 ELSE CAST({_SIM} AS DOUBLE) END AS score FROM gm), "
        f"pre AS ({arm} WHERE starts_with(title_lower, '{q}')), con AS ({arm} WHERE contains(title_lower, '{q}')), si AS ({arm} WHERE score > 0.4 * 0.3), "
        f"u AS (SELECT id, score, 0 AS o, p FROM pre WHERE p <= {fetch} UNION ALL SELECT id, score, 1, p FROM con WHERE p <= {fetch} UNION ALL SELECT id, score, 2, p FROM si WHERE p <= {fetch}), one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, p) AS r FROM u), trg AS (SELECT id, score, row_number() OVER (ORDER BY o, p) AS p FROM one WHERE r = 1), {near}, "
        f"al AS (SELECT id, score, 0 AS arm, p FROM fts WHERE p <= {fetch} UNION ALL SELECT id, score, 1, p FROM trg UNION ALL SELECT id, score, 2, p FROM vec WHERE p <= {4 * fetch}), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, arm, p) AS r FROM al), k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, arm, p) AS rank FROM f WHERE r = 1) "
        f"SELECT id, round(score, 6) AS score, ['fts', 'trgm', 'vector'][arm + 1] AS arm, rank FROM k WHERE rank > {offset} AND rank <= {offset + limit}"
    )


@query("M3_hybrid_scoped", _hybrid_sql(("the", "of"), "src1", 10, 5, 1))
def _(spark, d):
    # two words, an archive, a page and a vector of the query's own
    a = view(spark, d, "v_articles")
    q = table(spark, d, "embeddings").where("vec_id = 1").select(F.lit(0).cast("bigint").alias("query_id"), F.lit("the of").alias("q"), F.lit("src1").alias("archive"), F.lit(10).alias("limit"), F.lit(5).alias("offset"), F.col("embedding").alias("vector"))
    return R.hybrid_search(q, a, R.postings(a), _all_vectors(spark, d)).select("id", F.round("score", 6).alias("score"), "arm", F.col("rank").cast("bigint").alias("rank"))


@query("M4_page", "WITH r AS (SELECT id, row_number() OVER (ORDER BY id % 13 DESC, id) AS rank FROM v_titles) SELECT id, rank FROM r WHERE rank > 120 AND rank <= 130")
def _(spark, d):
    # an arm keeps as many rows as the page reaches
    ranked = R.top_k(view(spark, d, "v_titles").select(F.lit(0).alias("query_id"), "id", (F.col("id") % 13).alias("score")), 130, "fts")
    return R.page(ranked.withColumn("rank", F.col("arm_pos").cast("bigint")), 10, 120).select("id", "rank")


@query("M5_suggest", f"WITH {_TITLES.replace('red widget', 'red')}, pre AS (SELECT id, sim, 0 AS g, row_number() OVER (ORDER BY sim DESC, id) AS p FROM ts WHERE starts_with(title_lower, q)), con AS (SELECT id, sim, 1 AS g, row_number() OVER (ORDER BY sim DESC, id) AS p FROM ts WHERE contains(title_lower, q)), si AS (SELECT id, sim, 2 AS g, row_number() OVER (ORDER BY sim DESC, id) AS p FROM ts WHERE sim > 0.3), u AS (SELECT * FROM pre WHERE p <= 20 UNION ALL SELECT * FROM con WHERE p <= 20 UNION ALL SELECT * FROM si WHERE p <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g) AS r FROM u), k AS (SELECT id, sim, least(g, 1) AS grp, row_number() OVER (ORDER BY least(g, 1), sim DESC, g, p) AS rank FROM o WHERE r = 1) SELECT id, CAST(round(sim, 6) AS DOUBLE) AS score, grp, rank FROM k WHERE rank <= 20")
def _(spark, d):
    return R.suggest(_q(spark, "red"), view(spark, d, "v_titles"), 20).select("id", F.round("score", 6).alias("score"), "grp", F.col("rank").cast("bigint").alias("rank"))


@query("M6_deep_search", f"SELECT h.id, h.rank, CASE WHEN length(text) > 4000 THEN concat(substring(text, 1, 4000), '…') ELSE text END AS body FROM ({_hybrid_sql(('the', 'of'), 'src1', 5, 0, 1)}) h JOIN documents ON doc_id = h.id")
def _(spark, d):
    a = view(spark, d, "v_articles")
    q = table(spark, d, "embeddings").where("vec_id = 1").select(F.lit(0).cast("bigint").alias("query_id"), F.lit("the of").alias("q"), F.lit("src1").alias("archive"), F.col("embedding").alias("vector"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.deep_search(q, a, R.postings(a), texts, _all_vectors(spark, d)).select("id", F.col("rank").cast("bigint").alias("rank"), "body")


@query("M7_recent", "SELECT id, updated_at FROM v_transfers ORDER BY updated_at DESC, id LIMIT 500")
def _(spark, d):
    return L.recent(view(spark, d, "v_transfers"), "updated_at", 500).select("id", "updated_at")


_SEEK = "SELECT l_orderkey * 7 + l_linenumber AS target, coalesce((SELECT min(id) FROM v_transfers WHERE id >= l_orderkey * 7 + l_linenumber), (SELECT max(id) FROM v_transfers WHERE id <= l_orderkey * 7 + l_linenumber)) AS found FROM lineitem"


@query("M8_seek", _SEEK)
def _(spark, d):
    # targets within all ids and beyond the last
    t = table(spark, d, "lineitem").select(F.expr("l_orderkey * 7 + l_linenumber").alias("target"))
    return L.seek(t, "target", view(spark, d, "v_transfers").select("id")).select("target", F.col("id").alias("found"))


@query("M9_random_pick", "WITH b AS (SELECT min(id) AS lo, max(id) AS hi FROM v_articles WHERE archive = 'src1') SELECT coalesce((SELECT min(id) FROM v_articles, b WHERE archive = 'src1' AND id >= lo + 12345 % (hi - lo + 1)), (SELECT max(id) FROM v_articles WHERE archive = 'src1')) AS id")
def _(spark, d):
    return L.random_pick(R.scope_filter(view(spark, d, "v_articles"), "src1"), 12345)


@query("M10_fifo_take", "SELECT archive, id FROM (SELECT archive, id, row_number() OVER (PARTITION BY archive ORDER BY id) AS r FROM v_articles) WHERE r <= 7")
def _(spark, d):
    return L.fifo_take(view(spark, d, "v_articles"), "archive", 7).select("archive", "id")


@query("M11_set_difference", "SELECT name, 'removed' AS side FROM (SELECT name FROM v_catalog EXCEPT SELECT name FROM v_snapshot) UNION ALL SELECT name, 'added' FROM (SELECT name FROM v_snapshot EXCEPT SELECT name FROM v_catalog) UNION ALL SELECT name, 'both' FROM (SELECT name FROM v_catalog INTERSECT SELECT name FROM v_snapshot)")
def _(spark, d):
    return set_difference(view(spark, d, "v_catalog"), view(spark, d, "v_snapshot"))
