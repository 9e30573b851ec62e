import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codexlake import cluster
from codexlake.functions.text import trigrams
from codexlake.operators import catalog as C
from codexlake.operators import cells as C_
from codexlake.operators import embedding as E
from codexlake.operators import grams as G_
from codexlake.operators import ledger as G
from codexlake.operators import library as B
from codexlake.operators import lookup as L
from codexlake.operators import retrieval as R
from codexlake.operators import websearch as W
from codexlake.plans import search  # noqa: F401  it registers its queries
from codexlake.plans.registry import QUERIES
from codexlake.sources import reader
from codexlake.sources import versions as V
from codexlake.sources.views import view

COLOURS, THINGS = ["teal", "ochre", "mauve", "sepia"], ["kettle", "ladder", "piano", "rudder", "sickle", "thimble"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Article i is about a thing of a colour: 24 pairs, each of 50 articles; a third of them names the thing first."""
    rows = []
    for i in range(1200):
        c, t = COLOURS[i % 4], THINGS[i // 4 % 6]
        title = f"{t} painted {c}" if i % 3 == 0 else f"{c} {t}"
        rows.append((i, f"a{i % 5}", "p", title, f"no {i} of the well-kept {t} list", "en" if i % 2 else "fr"))
    return spark.createDataFrame(rows, "id bigint, archive string, path string, title string, content_preview string, language string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id bigint, q string")


def test_exact_answers_and_pages(spark, corpus):
    q = asked(spark, "mauve piano", "")
    posted = R.postings(corpus)
    found = R.fts_match(q, posted).collect()
    want = {i for i in range(1200) if COLOURS[i % 4] == "mauve" and THINGS[i // 4 % 6] == "piano"}
    assert {(r.query_id, r.id) for r in found} == {(0, i) for i in want} and len(found) == 50
    first = R.hybrid_search(q, corpus, posted, limit=10).orderBy("rank").collect()
    second = R.hybrid_search(q, corpus, posted, limit=10, offset=10).orderBy("rank").collect()
    assert len(first) == 10 and not {r.id for r in first} & {r.id for r in second}
    scores = [r.score for r in first + second]
    assert scores == sorted(scores, reverse=True)
    assert R.scope_filter(corpus, "absent").count() == 0


def test_query_language(spark, corpus):
    """Phrases, or, minus and hyphens against a plain reading of each query."""
    plain = {r.id: f" {r.title} {r.content_preview} ".replace("-", " ") for r in corpus.collect()}
    cases = {
        "mauve piano": lambda t: " mauve " in t and " piano " in t, '"mauve piano"': lambda t: " mauve piano " in t, '"piano mauve"': lambda t: False, "MAUVE or rudder": lambda t: " mauve " in t or " rudder " in t,
        "mauve -piano": lambda t: " mauve " in t and " piano " not in t, 'mauve -"mauve piano"': lambda t: " mauve " in t and " mauve piano " not in t, "well-kept": lambda t: " well kept " in t,
        "kept-well": lambda t: False, 'teal kettle or "sepia thimble" -painted': lambda t: (" teal " in t and " kettle " in t) or " sepia thimble " in t and " painted " not in t,
        "-mauve": lambda t: False, "or or": lambda t: False, '"unclosed mauve': lambda t: False, "...": lambda t: False, 'ladder or': lambda t: " ladder " in t,
    }
    got = {}
    for r in R.fts_match(asked(spark, *cases), R.postings(corpus)).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    for k, (q, want) in enumerate(cases.items()):
        assert got.get(k, set()) == {i for i, t in plain.items() if want(t)}, q


def test_stored_index_answers_alike(spark, corpus, tmp_path):
    q = asked(spark, "mauve piano", '"teal kettle" or sickle -painted', "ladder", "absent piano", "-mauve piano", '"well-kept teal"', "piano or absent thing", "the", "mauve mauve")
    W.write_index(R.postings(corpus), str(tmp_path / "index"), rows_a_part=500)
    stored = W.open_index(spark, str(tmp_path / "index"))
    assert stored.parts > 10
    key = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
    plain = key(R.fts_match(q, R.postings(corpus)))
    assert key(R.fts_match(q, stored)) == plain and len({r[0] for r in plain}) > 4
    assert "PartitionFilters: [part" in R.phrase_match(q.limit(1), stored)._jdf.queryExecution().toString()
    # a token of more rows than a part holds lies in several parts
    held = spark.read.parquet(str(tmp_path / "index" / "rows"))
    assert held.where("token = 'list'").select("part").distinct().count() > 1 and held.count() == R.postings(corpus).count()


def test_bounds_leave_the_best_alone(spark, tmp_path):
    """The best rows are those of all rows, for two-word queries over texts of few words, with and without an index."""
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choices(words, range(1, 13), k=n))
    a = spark.createDataFrame([(i, text(rng.randint(0, 4)), text(rng.randint(0, 60))) for i in range(400)], "id bigint, title string, content_preview string")
    q = asked(spark, *[f"{x} {y}" for x in words[::2] for y in words[1::3]], "w11 or w10 w9", '"w11 w10" w9', "w3")
    W.write_index(R.postings(a), str(tmp_path / "index"))
    key = lambda df: sorted((r.query_id, r.id, r.arm_pos, round(r.score, 9)) for r in df.collect())
    whole = key(R.top_k(R.fts_match(q, R.postings(a)), 5, "fts"))
    stored = W.open_index(spark, str(tmp_path / "index"))
    few = R.fts_match(q, stored, 5)
    assert key(R.top_k(few, 5, "fts")) == whole and key(R.top_k(R.fts_match(q, R.postings(a), 5), 5, "fts")) == whole
    assert few.count() < R.fts_match(q, stored).count()


def test_each_query_has_its_own_scope_and_page(spark, corpus):
    rows = [(0, "mauve piano", None, None, 5, 0), (1, "mauve piano", "a2", None, 50, 0), (2, "mauve piano", None, "fr", 7, 2), (3, "piano", "absent", None, 10, 0)]
    q = spark.createDataFrame(rows, "query_id bigint, q string, archive string, language string, limit int, offset int")
    got = {}
    for r in R.hybrid_search(q, corpus, R.postings(corpus), highlighted=True).collect():
        got.setdefault(r.query_id, []).append(r)
    assert len(got[0]) == 5 and 3 not in got
    assert {r.archive for r in got[1]} == {"a2"} and sum("mauve" in r.title and "piano" in r.title for r in got[1]) == 10
    assert {r.language for r in got[2]} == {"fr"} and sorted(r.rank for r in got[2]) == [3, 4, 5, 6, 7, 8, 9]
    assert any("<b>piano</b>" in r.snippet for r in got[1]) and all(r.snippet for rs in got.values() for r in rs)


def test_vectors_may_be_missing_and_ties_go_by_id(spark, corpus):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 8, 7, 3, 2, 1)] + [(4, None), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0])], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, [3.0, 6.0, 9.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, q array<double>")
    assert sorted((r.query_id, r.id, r.arm_pos) for r in R.vector_arm(q, v, 2).collect()) == [(0, 1, 1), (0, 2, 2), (1, 6, 1)]
    assert R.vector_arm(q.limit(0), v, 2).count() == 0
    none = spark.createDataFrame([(0, "mauve", "fts", [1.0, 0.0]), (1, "ab", None, [1.0, 0.0])], "query_id bigint, q string, mode string, vector array<double>")
    assert {r.query_id for r in R.hybrid_search(none, corpus, R.postings(corpus), v).collect()} == {0}


def test_plans_have_no_products(spark, corpus):
    q = spark.createDataFrame([(0, "mauve piano")], "query_id bigint, q string")
    for df in (R.fts_match(q, R.postings(corpus)), R.similar_titles(q, corpus.select("id", F.lower("title").alias("title_lower")))):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_query_is_an_error(spark, corpus):
    q = spark.createDataFrame([(0, "x" * 501)], "query_id bigint, q string")
    with pytest.raises(Exception, match="longer than 500"):
        R.hybrid_search(q, corpus, R.postings(corpus)).collect()


def test_seek(spark):
    ids = spark.createDataFrame([(5,), (70_000,), (200_000,)], "id bigint")
    t = spark.createDataFrame([(x,) for x in (0, 5, 6, 70_001, 200_000, 200_001, 9_000_000)], "at bigint")
    got = {r.at: r.id for r in L.seek(t, "at", ids).collect()}
    assert got == {0: 5, 5: 5, 6: 70_000, 70_001: 200_000, 200_000: 200_000, 200_001: 200_000, 9_000_000: 200_000}


def test_random_pick_of_nothing(spark):
    with pytest.raises(Exception, match="empty"):
        L.random_pick(spark.createDataFrame([], "id bigint"), 3).collect()


def test_transitions_in_order(spark):
    ledger = spark.createDataFrame([(1, "queued"), (2, "complete")], "id bigint, status string")
    c = spark.createDataFrame([(1, 1, "complete"), (1, 2, "downloading"), (1, 3, "complete"), (2, 1, "queued")], "id bigint, seq bigint, to string")
    got = {r.id: (r.status, r.applied, r.rejected) for r in G.apply_transitions(ledger, c).collect()}
    assert got == {1: ("complete", 2, 1), 2: ("complete", 0, 1)}


def test_vector_queries_search_every_row(spark):
    for name in ("T9_vector_arm", "T10_vector_arm_ann"):
        rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        found = {r.query_id for r in rows if r.id == r.query_id}
        assert found == {r.query_id for r in rows} and all(i % 100 == 0 for i in found)


def test_cells_recall(spark, tmp_path):
    """The ten nearest of 10,000 vectors, with and without clusters, with a tenth of them and less compared exactly."""
    import numpy as np

    rng = np.random.default_rng(8)
    loose = rng.standard_normal((5000, 64))
    close = rng.standard_normal((50, 64)).repeat(100, axis=0) + 0.6 * rng.standard_normal((5000, 64))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([loose, close]))], "id bigint, embedding array<double>")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    C_.write_cells(v, str(tmp_path / "cells"))
    index = C_.open_cells(spark, str(tmp_path / "cells"))
    assert len(index.centres) == 100 and spark.read.parquet(str(tmp_path / "cells" / "rows")).count() == 10_000
    exact = {(r.query_id, r.id) for r in R.vector_arm(q, v, 10).collect()}
    found = R.vector_arm_ann(q, index, 10).collect()
    assert len(exact & {(r.query_id, r.id) for r in found}) / len(exact) >= 0.9 and max(C_.RERANKED, 10 * C_.RERANKED_EACH) < 1000
    assert {r.query_id for r in found if r.id == r.query_id and r.arm_pos == 1} == set(range(0, 10_000, 100))
    # in parts of the batch; and only the parts of the probed cells are read
    assert {(r.query_id, r.id) for r in C_.search_cells(q, index, 10, most_queries=30).collect()} == {(r.query_id, r.id) for r in found}
    assert "PartitionFilters: [part" in C_.search_cells(q.limit(1), index, 10, probes=8)._jdf.queryExecution().toString()


def test_cells_odd(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [-2.0, 0.0]), (7, [3.0, 0.0])], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(0, [5.0, 0.0]), (1, None), (2, [0.0, 0.0])], "query_id bigint, q array<double>")
    for name, rows, want in (("some", v, [(0, 1), (0, 7)]), ("none", v.limit(0), []), ("odd", v.where("id between 2 and 5"), [])):
        C_.write_cells(rows, str(tmp_path / name))
        assert sorted((r.query_id, r.id) for r in C_.search_cells(q, C_.open_cells(spark, str(tmp_path / name)), 2).collect()) == want
    with pytest.raises(Exception, match="dimensions"):
        C_.search_cells(spark.createDataFrame([(0, [1.0])], "query_id bigint, q array<double>"), C_.open_cells(spark, str(tmp_path / "some")), 2).collect()


def test_feed_and_articles(spark, tmp_path):
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a</id><title>A</title><link rel="x/acquisition" href="http://h/a_2024-01.zim" type="t"/></entry><entry><title>B</title></entry><entry></entry></feed>')
    rows = reader.read_feed(spark, str(tmp_path / "feed.xml")).orderBy("title").collect()
    assert [r.title for r in rows] == ["A", "B"] and rows[0].links[0]["_href"] == "http://h/a_2024-01.zim"
    reader.write_articles(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, archive string"), str(tmp_path / "out"))
    reader.write_articles(spark.createDataFrame([(3, "b")], "id bigint, archive string"), str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_streams_continue(spark, tmp_path):
    from codexlake.streaming import jobs

    rows = pd.DataFrame({"branch": [1] * 6, "seq": range(6), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(range(6), unit="min"), "ok": [1, 0, 0, 0, 1, 0]})
    (tmp_path / "in").mkdir()
    schema = "branch bigint, seq bigint, ts timestamp, ok int"
    for lo, hi in ((0, 3), (3, 6)):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = jobs.run_available(jobs.degradation(stream), folder=str(tmp_path / "job"))
    assert [(r.seq, r.failures) for r in got.orderBy("seq").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1)]


def test_upserts_of_several_batches(spark, tmp_path):
    from codexlake.streaming import jobs

    schema = "k bigint, seq bigint"
    for lo in (0, 10, 20):
        spark.createDataFrame([(i % 7, i) for i in range(lo, lo + 10)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.upsert_latest(stream, str(tmp_path / "out"), ["k"], "seq")
    got = {r.k: r.seq for r in jobs.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {k: max(i for i in range(30) if i % 7 == k) for k in range(7)}
    assert V.versions(spark, str(tmp_path / "out")) == [1, 2]


def test_pages_in_batches_are_the_pages_at_once(spark, tmp_path):
    """Three arrivals give the rows of one batch run; a small arrival rewrites its own buckets only, and a version that runs again replaces itself."""
    from codexlake.streaming import jobs

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    ingest = lambda: jobs.ingest_pages(jobs.pages(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), 32)
    for k in range(3):
        pages.where(f"page_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest()
    key = lambda df: sorted(map(repr, df.collect()))
    whole = V.latest(reader.pages_to_articles(pages), ["path"], "page_id")
    assert key(jobs.read_latest(spark, str(tmp_path / "out"))) == key(whole.select(*jobs.read_latest(spark, str(tmp_path / "out")).columns))
    before = V.manifest(spark, str(tmp_path / "out"), 2)
    some = pages.where("page_id = 7").withColumns({"page_id": F.lit(1000).cast("bigint"), "html": F.lit("<title>New</title><p>new text</p>")})
    some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest()
    after = V.manifest(spark, str(tmp_path / "out"), 3)
    assert len(before) > 10 and [p for p in after if after[p] != before[p]] == [p for p, v in after.items() if v == 3] and sum(v == 3 for v in after.values()) == 1
    assert [(r.page_id, r.title) for r in jobs.read_latest(spark, str(tmp_path / "out")).where("page_id >= 1000").collect()] == [(1000, "New")]
    # version 2 is still whole; writing 3 again from it gives the same
    old = V.read_version(spark, str(tmp_path / "out"), version=2)
    assert key(old) == key(whole.select(*old.columns))
    part = next(p for p, v in after.items() if v == 3)
    V.write_version(old.limit(0).withColumn("part", F.lit(part)), str(tmp_path / "out"), 3, {part})
    assert V.manifest(spark, str(tmp_path / "out"), 3) == {p: v for p, v in before.items() if p != part}


def test_ingest_parses_on_all_cores(spark, monkeypatch):
    """A micro-batch of the ingest query has a file for each core, as one file may be one task; there are three of them."""
    from codexlake.plans import streams

    seen, ingest, pages = [], streams.S.ingest_pages, streams.S.pages
    monkeypatch.setattr(streams.S, "pages", lambda s, path, n: seen.append((path, n)) or pages(s, path, n))
    monkeypatch.setattr(streams.S, "ingest_pages", lambda stream, path: seen.append(path) or ingest(stream, path))
    got = QUERIES["R1_stream_ingest"](spark, "/root/testdata/sf0.01")
    whole = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.groupBy(F.col("url").alias("path")).agg(F.max("page_id").alias("page_id")).collect()))
    (folder, most), out = seen
    files = spark.read.parquet(folder).inputFiles()
    assert -(-len(files) // most) == 3 and most >= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(folder).count() == whole.count() and max(V.versions(spark, out)) == 2


def test_matching_uses_up_rows(spark):
    ledger = spark.createDataFrame([(1, "A", "u", "h1"), (2, "b", "u", None), (3, "B", "u", None), (4, "x", "C", None), (5, "b", "u", "gone")], "id bigint, name string, url string, digest string")
    listing = spark.createDataFrame([("h1", "zz", 10), ("h2", "B", 11), (None, "c", 12), ("h4", "b", 13)], "hash string, name string, seq bigint")
    assert sorted((r.id, r.seq) for r in G.match_listing(ledger, listing).collect()) == [(1, 10), (2, 13), (4, 12)]


def test_matching_in_ledger_order(spark):
    """Brute force: rows one after the other, with the set of entries that are taken."""
    import random

    rng = random.Random(5)
    for names in (2, 8, 40):
        listing = [(rng.choice([None, "", f"h{rng.randrange(30)}"]), rng.choice("nN") + str(rng.randrange(names)), k) for k in range(60)]
        ledger = [(i, rng.choice("nN") + str(rng.randrange(names * 2)), f"N{rng.randrange(names)}", rng.choice([None, None, f"h{rng.randrange(40)}"])) for i in rng.sample(range(500), 80)]
        by_hash, by_name = {h: (h, n, s) for h, n, s in listing if h}, {n.lower(): (h, n, s) for h, n, s in listing}
        for too in (False, True):
            taken, want = set(), set()
            for i, name, url, digest in sorted(ledger):
                hit = by_hash.get(digest) if digest else None
                if hit is None and (digest is None or too):
                    hit = by_name.get(name.lower()) or by_name.get(url.lower())
                    hit = hit if hit and (hit[0] or f"name:{hit[1].lower()}") not in taken else None
                if hit:
                    taken.add(hit[0] or f"name:{hit[1].lower()}")
                    want.add((i, hit[2]))
            got = G.match_listing(spark.createDataFrame(ledger, "id bigint, name string, url string, digest string"), spark.createDataFrame(listing, "hash string, name string, seq bigint"), too)
            assert sorted((r.id, r.seq) for r in got.collect()) == sorted(want)
    # bound by hash, then found by name: the second row gets nothing
    two = spark.createDataFrame([(1, "B", "u", "h1"), (2, "B", "u", None)], "id bigint, name string, url string, digest string")
    assert [(r.id, r.seq) for r in G.match_listing(two, spark.createDataFrame([("h1", "B", 10)], "hash string, name string, seq bigint")).collect()] == [(1, 10)]


def test_matching_joins_no_nulls(spark, tmp_path):
    """Rows without a digest, a name or a url never meet in one task of a join, and rows of one name and url are joined as one; the answers stay."""
    rows = [(i, [None, "a", "B", "gone"][i % 4], [None, "u", "A"][i % 3], "h1" if i % 50 == 49 else None) for i in range(1200)]
    spark.createDataFrame(rows, "id bigint, name string, url string, digest string").write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    listing = spark.createDataFrame([("h1", "x", 1), ("h2", "a", 2), (None, "b", 3)], "hash string, name string, seq bigint")
    bound = [(i, 1) for i in range(49, 1200, 50)]
    # the first without a digest that is named a, or else has that url, and the first that is named b
    assert sorted((r.id, r.seq) for r in G.match_listing(ledger, listing).collect()) == sorted([*bound, (1, 2), (2, 3)])
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(c, v)
        for too in (False, True):
            plan = G.match_listing(ledger, listing, too)._jdf.queryExecution().executedPlan().toString()
            # no join by digest sees a row without one, and names and urls are grouped before they are joined
            outer = len(re.findall(r"SortMergeJoin \[digest#\d+\].*LeftOuter", plan))
            assert (outer == 0 or too) and re.search(r"keys=\[_name#\d+, _url#\d+\]", plan) and re.search(r"isnotnull\(digest#", plan)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_reconcile_adopts_what_none_knows(spark):
    ledger = spark.createDataFrame([(1, "a", "http://h/a.torrent", "h1", "downloading"), (2, "b", "http://h/b.torrent", None, "queued"), (3, "c", "http://h/c.zim", "h3", "downloading")], "id bigint, name string, url string, digest string, status string").withColumn("updated_at", F.expr("TIMESTAMP '2024-01-01'"))
    listing = spark.createDataFrame([("h1", "x", 1.0, "uploading", 5), ("h2", "B", 0.1, "downloading", 6), ("h3", "C", 0.5, "downloading", 7), (None, "new", 0.5, "downloading", 8)], "hash string, name string, progress double, state string, seq bigint")
    as_of = spark.sql("SELECT TIMESTAMP '2024-01-02' AS as_of")
    assert {(r.id, r.seq, r.action) for r in G.reconcile(ledger, listing, as_of).collect()} == {(1, 5, "finish"), (2, 6, "bind"), (3, None, "keep"), (None, 7, "adopt"), (None, 8, "adopt")}


def test_stats_touch_only_what_changed(spark):
    ledger = spark.createDataFrame([(1, 0.7, 1.0, 2), (2, 0.7, 1.0, 2), (3, 0.7, 1.0, 2), (4, 0.7, None, None)], "id bigint, progress double, ratio double, num_seeds bigint").withColumn("updated_at", F.expr("timestamp_seconds(1000 + id * 100)"))
    stats = spark.createDataFrame([(2, 0.7, 1.0, 2, 0, 0, 10), (3, 0.75, 1.0, 2, 4, 0, 8192), (4, 0.7, 0.0, 0, 0, 0, 1)], "id bigint, progress double, ratio double, num_seeds bigint, dlspeed bigint, upspeed bigint, remaining bigint")
    got = {r.id: (r.progress, r.speed_bps, r.eta_secs, r.t) for r in G.apply_stats(ledger, stats, F.expr("timestamp_seconds(1450)")).withColumn("t", F.unix_timestamp("updated_at")).collect()}
    # not shown; unchanged but idle for long; changed; unchanged and fresh
    assert got == {1: (0.7, None, None, 1100), 2: (0.7, None, None, 1450), 3: (0.75, 4096, 2, 1450), 4: (0.7, None, None, 1400)}


def test_new_vectors_leave_the_others(spark):
    old = spark.createDataFrame([(1, [1.0], "m0"), (2, [2.0], "m0"), (3, None, None)], "id bigint, embedding array<double>, model string")
    new = spark.createDataFrame([(2, [9.0]), (3, None)], "id bigint, embedding array<double>")
    got = E.apply_vectors(old, new, "m1", F.expr("TIMESTAMP '2024-01-01'")).orderBy("id").collect()
    assert [(r.id, r.embedding, r.model, r.embed_at is not None) for r in got] == [(1, [1.0], "m0", False), (2, [9.0], "m1", True), (3, None, None, False)]


def test_updates_of_undated_archives(spark):
    feed = [("http://h/wiki.zim", "2024-09-03T00:00:00Z", 0), ("http://h/wiki_2024-08.zim", "2023-01-01", 1), ("http://h/Wiki.zim", "2024-09-30", 2), ("http://h/x.torrent", "2030-01-01", 3), ("http://h/maps.zim", None, 4), ("http://h/star.zim", "2024-1", 5), ("http://h/star_2024-02.zim", "2024-03-05", 6)]
    f = spark.createDataFrame(feed, "href string, updated string, feed_pos bigint")
    local = spark.createDataFrame([("wiki", "2024-01-15"), ("wiki_2024-01", "2024-02-01"), ("wiki_2024-09", "2024-09-01"), ("maps", "2020-01-01"), ("star", "2024-02-01"), ("tide", None)], "name string, date string")
    got = {r.name: r.feed_pos for r in C.find_updates(f, local).collect()}
    # an undated entry counts by its month; a dated pair by its dates; without a date on either side nothing is newer
    assert got == {"wiki": 0, "wiki_2024-01": 0, "star": 6}
    assert {r.name: r.feed_pos for r in C.find_updates(f, local.select("name")).collect()} == {"wiki_2024-01": 1}


def test_listing_candidates(spark):
    ledger = spark.createDataFrame([(1, "A")], "id bigint, name string")
    listing = spark.createDataFrame([("a", "Cat", 1), ("a", None, 2), ("A", "dog", 3)], "name string, category string, seq bigint")
    assert [r.seq for r in G.listing_candidates(ledger, listing, "cAT").collect()] == [1]
    assert [r.seq for r in G.listing_candidates(ledger, listing, "").collect()] == [2]
    assert G.listing_candidates(ledger, listing.drop("category"), "cat").count() == 0


def test_gram_index_answers_alike(spark, corpus, tmp_path):
    """Stored grams give the rows of the arms over titles, whatever the parts; hot grams go on in other parts."""
    titles = corpus.select("id", F.lower("title").alias("title_lower")).unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, "ab"), (5003, "%_a\\"), (5004, "mauve"), (5005, "zz top zz"), (5006, "é字é")], "id bigint, title_lower string"))
    q = asked(spark, "mauve piano", "MAUVE", "ma", "m", "", None, "xyz", "zz t", "%_a", "é字é", "kettle teal", "rudder painted oc")
    G_.write_gram_index(titles, str(tmp_path / "grams"), rows_a_part=300)
    index = G_.open_gram_index(spark, str(tmp_path / "grams"))
    assert index.similar.parts > 1 and index.raw.parts > 1
    key = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    for f in (lambda t: R.similar_titles(q, t), lambda t: R.similar_titles(q, t, 0.6), lambda t: R.prefix_scores(q, t, 0.4), lambda t: R.contains_scores(q, t, 1.0), lambda t: R.trigram_arms(q, t, 7).select("query_id", "id", "arm_pos"), lambda t: R.suggest(q, t, 9).select("query_id", "id", "rank")):
        assert key(f(index)) == key(f(titles))
    assert "PartitionFilters: [part" in R.prefix_scores(q, index, 0.4)._jdf.queryExecution().toString()
    # places and sizes leave fewer pairs than shared grams do
    each = lambda df, c: df.select(F.col(df.columns[0]).alias("k"), F.explode(trigrams(c)).alias("gram"))
    assert G_.candidates(q, index, 0.6).count() * 2 < each(q, "q").join(each(titles, "title_lower").withColumnRenamed("k", "t"), "gram").count()


def test_reindex_writes_touched_archives_only(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(a, p, p.upper()) for a, p in xs], "archive string, path string, title string")
    links = spark.createDataFrame([("a/x", "p1", 1), ("a/x", "p9", 2), ("b", "p1", 3)], "archive string, path string, qid bigint")
    path = str(tmp_path / "t")
    C.merge_reindex(path, rows(("a/x", "p1"), ("a/x", "p2"), ("b", "p1")), links, F.expr("DATE '2024-01-01'"))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("t/articles/data/version=0/*/*.parquet")}
    ids = lambda: {(r.archive, r.path): r.id for r in V.read_version(spark, f"{path}/articles").collect()}
    before, first = files(), ids()
    assert C.merge_reindex(path, rows(("a/x", "p3"), ("a/x", "p2")), links, F.expr("DATE '2024-02-02'")) == 1
    assert C.merge_reindex(path, rows(), links, F.expr("DATE '2024-02-02'")) == 1
    assert files() == before and sorted(first.values()) == [0, 1, 2]
    assert ids() == {("a/x", "p2"): first["a/x", "p2"], ("a/x", "p3"): 3, ("b", "p1"): first["b", "p1"]}
    assert [(r.archive, r.qid) for r in V.read_version(spark, f"{path}/links").collect()] == [("b", 3)]
    assert {(r.archive, str(r.updated_at)) for r in V.read_version(spark, f"{path}/archives").collect()} == {("a/x", "2024-02-02"), ("b", "2024-01-01")}


def test_guards_forget_idle_keys(spark, tmp_path):
    """State goes by timers; a run in two parts gives the rows of one."""
    from codexlake.streaming import jobs

    minute = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k)
    errors = [(1, 0, minute(0), "timeout"), (1, 1, minute(1), "timeout"), (2, 2, minute(2), "HTTP 403"), (2, 3, minute(3), "HTTP 403"), (1, 4, minute(4), "timeout"), (3, 5, minute(500), "other"), (1, 6, minute(600), "timeout"), (1, 7, minute(601), "timeout")]
    schema = "key bigint, seq bigint, ts timestamp, message string"
    want = [(0, 1, False), (1, 2, False), (2, 0, False), (3, 0, False), (4, 3, True), (5, 1, False), (6, 1, False), (7, 2, False)]
    for parts in ((8,), (3, 5, 6, 8)):
        folder, lo = tmp_path / str(len(parts)), 0
        for hi in parts:
            spark.createDataFrame(pd.DataFrame(errors[lo:hi], columns=["key", "seq", "ts", "message"]), schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            got = jobs.run_available(jobs.retry_guard(spark.readStream.schema(schema).parquet(str(folder / "in")), idle_minutes=100), folder=str(folder / "job"))
            lo = hi
        assert [(r.seq, r.streak, r.give_up) for r in got.orderBy("seq").collect()] == want
    fails = [(1, k, minute(k), 0) for k in range(5)] + [(2, 5, minute(5), 0), (2, 6, minute(6), 1)] + [(2, 7 + k, minute(7 + k), 0) for k in range(4)] + [(1, 20, minute(40), 0), (2, 21, minute(41), 0)]
    schema = "branch bigint, seq bigint, ts timestamp, ok int"
    for lo, hi in ((0, 4), (4, 13)):
        spark.createDataFrame(pd.DataFrame(fails[lo:hi], columns=["branch", "seq", "ts", "ok"]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "fails"))
        locks = jobs.run_available(jobs.failure_bursts(spark.readStream.schema(schema).parquet(str(tmp_path / "fails"))), folder=str(tmp_path / "locks"))
    assert [(r.branch, r.seq) for r in locks.collect()] == [(1, 4)]


def test_equal_snapshots_do_nothing(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a bigint, b string")
    path = str(tmp_path / "s")
    assert [V.write_snapshot(a, path, 0), V.write_snapshot(a.orderBy(F.desc("a")), path, 1), V.write_snapshot(a.distinct(), path, 2), V.write_snapshot(a.limit(0), path, 3), V.write_snapshot(a.limit(0), path, 4)] == [True, False, True, True, False]
    assert V.versions(spark, path) == [2, 3] and V.read_version(spark, path, "a bigint, b string").count() == 0 and V.read_version(spark, path, version=2).count() == 2


def test_vectoriser_of_the_user(spark):
    """Batches that fail give their ids back; three failures take an article out, and the others go on."""
    articles = spark.createDataFrame([(i, "a", f"text {i}") for i in range(30)], "id bigint, archive string, content_preview string").repartition(1).sortWithinPartitions("id")
    archives = spark.createDataFrame([("a", True, "ready")], "name string, embed_enabled boolean, index_status string")
    vectors, failed = spark.createDataFrame([], "id bigint, embedding array<double>"), spark.createDataFrame([], "id bigint, seq bigint, ok int")

    def vectorise(texts):
        if any(t.strip() == "text 7" for t in texts):
            raise RuntimeError("overloaded")
        return [[1.0, float("nan") if t.strip() == "text 20" else len(t)] for t in texts]

    for run in range(4):
        got = E.embed_backlog(articles, archives, vectors, failed, vectorise, 2, batch=10).collect()
        bad = sorted(r.id for r in got if r.embedding is None)
        assert all((r.error is None) == (r.embedding is not None) for r in got)
        if run < 3:
            assert {7, 20} <= set(bad) and len(got) == (30 if run == 0 else len(left))
        else:
            assert not got
        left = set(bad)
        vectors = vectors.union(spark.createDataFrame([(r.id, r.embedding) for r in got if r.embedding], vectors.schema))
        failed = failed.union(spark.createDataFrame([(i, run, 0) for i in bad], failed.schema))
    assert any("overloaded" in r.error for r in E.embed_articles(articles.selectExpr("id", "content_preview AS text"), vectorise, 2, 10).where("error is not null").collect())
    with pytest.raises(ValueError, match="some of 3"):
        E.require_dimension(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 3), (3, None)], "id bigint, embedding array<double>"), 2)
    E.require_dimension(vectors.limit(0), 2)


def test_html_files_by_their_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_bytes('<html><head><meta charset="iso-8859-1"><title>Caf\xe9</title></head><p>d\xe9j\xe0 vu</p>'.encode("latin-1"))
    (tmp_path / "b").write_bytes("<title>Größe</title><p>straße</p>".encode())
    (tmp_path / "sub" / "c.txt").write_bytes("<title>x</title><p>字</p>".encode("utf-16"))
    (tmp_path / "d.html").write_bytes(b"\x89PNG\0\0\0")
    (tmp_path / "e.html").write_bytes(b"<meta charset=nonsense><title>y</title><p>z</p>")
    pages = reader.read_html_folder(spark, str(tmp_path))
    got = sorted((r.title, r.content_preview) for r in reader.pages_to_articles(pages).collect())
    assert got == [("Café", "déjà vu"), ("Größe", "straße"), ("x", "字"), ("y", "z")] and pages.select("page_id").distinct().count() == 4


def test_unknown_names_are_listed(spark):
    from codexlake.operators.library import required_ids

    archives = spark.createDataFrame([("a", 1), ("b", 2)], "name string, id int")
    assert sorted(map(tuple, required_ids(archives.select("name"), archives).collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="no such archives: x, y"):
        required_ids(spark.createDataFrame([("y",), ("a",), ("x",)], "name string"), archives)


def test_third_failure_of_one_message_gives_up(spark):
    rows = [(1, "a", "error", "timeout"), (2, "a", "error", "timeout"), (3, "a", "error", "timeout"), (4, "b", "error", "timeout"), (5, "b", "error", "refused"), (6, "b", "error", "timeout")]
    ledger = spark.createDataFrame(rows, "id bigint, name string, status string, error string").withColumn("updated_at", F.expr("TIMESTAMP '2024-01-01'"))
    assert [r.id for r in G.requeue(ledger, spark.sql("SELECT TIMESTAMP '2024-01-02' AS as_of")).collect()] == [6]


def test_titles_are_never_broadcast_and_equal_ones_scored_once(spark, tmp_path):
    """Spark takes the titles' grams for as small as their file; the batch's own are broadcast. Of copies the smallest ids stand in each query's best rows."""
    rows = [(i, ["red bolt", "red bolts", "blue anvil", "big red bolt", ""][i * 7 % 5]) for i in range(300)] + [(400, None)]
    spark.createDataFrame(rows, "id bigint, title_lower string").write.parquet(str(tmp_path / "titles"))
    titles = spark.read.parquet(str(tmp_path / "titles"))
    q = asked(spark, "red bolt", "RED BOLT", "blue", None, "anvil", "red bolt")
    for f in (lambda: R.similar_titles(q, titles), lambda: R.prefix_scores(q, titles, 1.0), lambda: R.contains_scores(q, titles, 1.0)):
        plan = f()._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    whole = {"similarity": R.similar_titles(q, titles).withColumnRenamed("sim", "score"), "prefix": R.prefix_scores(q, titles, 1.0), "contains": R.contains_scores(q, titles, 1.0)}
    arms = {"similarity": R.similarity_arm(q, titles, 70, weight=1.0), "prefix": R.prefix_arm(q, titles, 70, 1.0), "contains": R.contains_arm(q, titles, 70, 1.0)}
    key = lambda df: sorted((r.query_id, r.arm_pos, r.id, round(r.score, 9)) for r in df.collect())
    for arm, scored in whole.items():
        assert key(arms[arm]) == key(R.top_k(scored, 70, arm)) != []
    assert R._alike(titles, 70).once.count() == 5


def test_copies_of_titles_are_not_sorted_by_the_task_that_reads_them(spark, monkeypatch):
    """A task leaves the smallest ids of each title of some bytes at a time, so what it holds does not grow with a row group; none of the best is lost."""
    rows = [(i * 7919 % 5000 - 100, ["red bolt", "red bolts", "blue anvil", f"bolt {i}", None][i % 5]) for i in range(5000)]
    titles = spark.createDataFrame(rows, "id bigint, title_lower string")
    seen = []
    monkeypatch.setattr(R, "settle", lambda df: seen.append(df) or cluster.settle(df))
    want = sorted((t, i) for t in {t for _, t in rows if t} for i in sorted(i for i, x in rows if x == t)[:3])
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for held, batch in ((1 << 23, 10_000), (1 << 23, 300), (16_384, 300), (64, 300)):
        monkeypatch.setattr(R, "HELD_BYTES", held, raising=False)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        alike = R._alike(titles, 3)
        named = alike.once.withColumnRenamed("id", "first").join(alike.copies, "first")
        assert sorted((r.title_lower, r.id) for r in named.collect()) == want
        assert {(r.title_lower, r.id) for r in alike.once.collect()} == {(t, min(i for x, i in want if x == t)) for t, _ in want}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Sort [") == 1 and plan.index("Sort [") < plan.index("Exchange ")
    assert R.foremost(titles.coalesce(1).where("title_lower is not null"), "title_lower", 3).count() == len(want) < 4000


def test_cross_language_in_blocks(spark, monkeypatch):
    """Entities with many links meet block by block, each pair once; a link whose article is missing keeps a null title, one without an entity meets nothing."""
    monkeypatch.setattr(B, "BLOCK", 3)
    linked = [(i % 4, f"p{i}", i % 3 if i % 11 else None) for i in range(60)]
    links = spark.createDataFrame(linked, "archive_id int, path string, qid bigint")
    archives = spark.createDataFrame([(i, f"a{i}") for i in range(4)], "id int, name string")
    articles = spark.createDataFrame([(a, p, f"T{p}") for a, p, _ in linked if p != "p7"], "archive_id int, path string, title string")
    got = sorted(tuple(r) for r in B.cross_language(links, archives, articles).select("path", "qid", "archive", "other_path", F.coalesce("title", F.lit("-"))).collect())
    assert got == sorted((p, f"Q{q}", f"a{b}", o, f"T{o}" if o != "p7" else "-") for a, p, q in linked for b, o, r in linked if q is not None and q == r and a != b)


def test_cross_language_is_dealt_to_tasks_by_its_pairs(spark, monkeypatch):
    """Few bytes make many pairs: tasks follow these, and no entity of two groups has to share one with all others. Copies, and links of archives without a name, are as in SQL."""
    for name, most in (("TASK_PAIRS", 100), ("MOST_TASKS", 64)):
        monkeypatch.setattr(B, name, most, raising=False)
    linked = [(i % 5 if i % 17 else None, f"p{i % 190}" if i % 23 else None, i % 7) for i in range(200)]
    links = spark.createDataFrame(linked, "archive_id int, path string, qid bigint")
    archives = spark.createDataFrame([(i, f"a{i}") for i in range(4)], "id int, name string")
    articles = spark.createDataFrame([(1, "p1", "T"), (1, "p1", "U"), (2, "p2", None)], "archive_id int, path string, title string")
    got = B.cross_language(links, archives, articles)
    for t, df in (("l", links), ("z", archives), ("a", articles)):
        df.createOrReplaceTempView(f"cross_{t}")
    want = spark.sql("SELECT l.path, concat('Q', l.qid) AS qid, z.name AS archive, o.path AS other_path, a.title FROM cross_l l JOIN cross_l o ON l.qid = o.qid AND l.archive_id <> o.archive_id JOIN cross_z z ON z.id = o.archive_id LEFT JOIN cross_a a ON a.archive_id = o.archive_id AND a.path = o.path")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    assert got.rdd.getNumPartitions() == 14
    assert B.cross_language(links.where("qid > 7"), archives, articles).count() == 0


def test_texts_do_not_move_to_meet_archives(spark):
    """Articles take their archive from a broadcast, so that texts are not shuffled."""
    assert "SortMergeJoin" not in view(spark, "/root/testdata/sf0.001", "v_articles")._jdf.queryExecution().executedPlan().toString()


def test_postings_meet_few_terms_without_a_shuffle(spark, corpus):
    """A batch's terms are broadcast, so a frequent word's postings do not land in one task; only what lies in a query's scope is scored."""
    terms = W.parsed(asked(spark, "mauve piano"))
    posted = R.postings(corpus)
    assert "SortMergeJoin" not in W.met(terms, posted)._jdf.queryExecution().executedPlan().toString()
    every = {(r.id, round(r.score, 9)) for r in W.ranked(terms, posted).collect()}
    some = {(r.id, round(r.score, 9)) for r in W.ranked(terms, posted, within=lambda found: found.where("id % 5 = 0")).collect()}
    assert some == {x for x in every if x[0] % 5 == 0} and 0 < len(some) < len(every)


def test_products_and_chunks_in_bounded_parts(spark, monkeypatch):
    """The nearest vectors and the chunks are the same however few a task holds at a time, and chunks leave in several batches."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    x[50:60] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(R, "MOST_PRODUCTS", 64)
    got = {(r.query_id, r.arm_pos): r.id for r in R.vector_arm(q, v, 12).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(i, k + 1): int(j) for i in range(0, 200, 20) for k, j in enumerate(np.lexsort((np.arange(200), -np.round(unit @ unit[i], 9)))[:12])}
    monkeypatch.setattr(reader, "CHUNKED", 300)
    docs = spark.createDataFrame([(i, None if i == 3 else "word " * i * 9) for i in range(20)], "doc_id bigint, text string")
    rows = [tuple(r) for r in reader.chunks(docs, 100, 20).collect()]
    assert sorted(rows) == [(i, k, *c) for i in range(20) if i != 3 for k, c in enumerate(reader.chunk_text("word " * i * 9, 100, 20))]


def test_guesses_are_kept_in_bounded_parts(spark, tmp_path, monkeypatch):
    """A task that keeps the best of few guesses at a time finds the same rows."""
    import numpy as np

    x = np.random.default_rng(5).normal(size=(400, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<double>").coalesce(1)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    C_.write_cells(v, str(tmp_path / "cells"), 10)
    index = C_.open_cells(spark, str(tmp_path / "cells"))
    rows = lambda: sorted(tuple(r) for r in C_.search_cells(q, index, 5, rerank=20).collect())
    whole = rows()
    monkeypatch.setattr(C_, "MOST_PENDING", 30)
    assert rows() == whole and len(whole) == 40
