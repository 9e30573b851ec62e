from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexlake.functions import text as X
from codexlake.operators.retrieval import cover_density
from codexlake.plans import scalars  # noqa: F401  it registers its queries
from codexlake.plans.registry import QUERIES
from codexlake.sources.reader import chunk_text, strip_html


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_dates(spark):
    given_ = ["2023-12-31", " 2023-12-31 01:02:03 ", "2023/12/31", "31/12/2023", "20231231", "2023-12-31T10:00:00", "2023-12-31T10:00:00Z", "garbage", "", "12/31/23", None]
    got = column(spark, given_, X.parse_date("v"))
    assert [str(g) for g in got[:7]] == ["2023-12-31"] * 7 and got[7:] == [None] * 4


def test_versions(spark):
    names = ["maps_of_rivers_2024-06", "recipes_fr_2024-01-15", "star_charts_202311", "tide_tables_2024x", "plain"]
    v = column(spark, names, X.version("v"))
    assert [x and (x.year, x.month) for x in v] == [(2024, 6), (2024, 1), (2023, 11), None, None]
    assert column(spark, names, X.base_name("v"))[0] == "maps_of_rivers"


def test_entities(spark):
    html = ["wikidata.org/wiki/Q99999999999999999999 wikidata.org/wiki/Q111", "wikidata.org/wiki/Q1 wikidata.org/wiki/Q555#identifiers", "x" * 524300 + "wikidata.org/wiki/Q5", None]
    assert column(spark, html, X.entity_id("v")) == [111, 555, None, None]


def test_redaction_and_names(spark):
    assert column(spark, ["http://u:p@h/a?x=b@c", "http://h/a@b", None], X.redact_url("v")) == ["http://***@h/a?x=b@c", "http://h/a@b", None]
    assert column(spark, ["ok.zim", "../x", ".hid", "a/b", "", "x" * 256], X.valid_name("v")) == [True, False, False, False, False, False]
    assert column(spark, ["HTTP 401", "x4012", "port 40152", "(403)", None], X.access_error("v")) == [True, False, False, True, False]


def floored(text, limit):
    """Plain version: whole characters of `limit` bytes, cut after the last stop."""
    if text is None or len(text.encode()) <= limit:
        return text
    head = text.encode()[:limit].decode(errors="ignore")
    stop = max(head.rfind(x) for x in ".!?") + 1
    return head[: stop or None].rstrip(" ") + "…"


def test_sentence_cut_in_bytes(spark):
    texts = [None, "", "é" * 150, "é" * 151, "a" + "é" * 150, "ab" + "字" * 100, "字" * 101, "a" + "𓀀" * 75, "ab" + "𓀀" * 75, "abc" + "𓀀" * 75, "é" * 30 + "a" * 260, "ü" * 140 + ". " + "x" * 30, "x. " + "é" * 290 + ".", "a" * 301]
    assert column(spark, texts, X.sentence_cut("v", 300)) == [floored(t, 300) for t in texts]


def test_snippets_and_cuts_of_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = QUERIES["C7_truncate_at_sentence"](spark, "/root/testdata/sf0.001")
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert any(t and len(t) < len(t.encode()) for _, t in texts)
    assert sorted(((r.doc_id, r.cut) for r in got.collect()), key=repr) == sorted(((i, floored(t, 300)) for i, t in texts), key=repr)
    cut = QUERIES["C5_snippet"](spark, "/root/testdata/sf0.001").collect()
    assert len(cut) == len(texts) and all(r.snippet is None or len(r.snippet.encode()) <= 303 or len(r.snippet) == 200 for r in cut)


def test_similarity_is_symmetric(spark):
    df = spark.createDataFrame([("red widget", "widget red"), ("", "a"), ("abc", "xyz"), ("abc", "abc")], "a string, b string")
    a, b = X.trigrams("a"), X.trigrams("b")
    for r in df.select(X.similarity(a, b).alias("x"), X.similarity(b, a).alias("y")).collect():
        assert r.x == r.y and 0 <= r.x <= 1


def test_chunk_example():
    # 12 bytes reach into "green", so the cut is after the line before it; the next begins 3 bytes earlier
    assert chunk_text("red\nblue\ngreen\ngrey", 12, 3) == [(0, 9, "red\nblue"), (6, 15, "ue\ngreen"), (12, 19, "en\ngrey")]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(10, 60), st.integers(0, 59))
def test_chunks_cover_and_advance(text, size, overlap):
    raw = text.encode()
    got = chunk_text(text, size, overlap)
    assert all(a < b for a, b, _ in got) and all(x[0] < y[0] for x, y in zip(got, got[1:], strict=False))
    held = bytearray(len(raw))
    for a, b, body in got:
        assert raw[a:b].decode().strip() == body
        held[a:b] = b"\1" * (b - a)
    left = bytes(c for c, h in zip(raw, held, strict=True) if not h)
    assert not left.decode("utf-8", "ignore").strip()


def test_strip_html():
    title, text = strip_html("<html><title>A &amp; B</title><script>var x='<p>'</script><p>One<br>two&eacute;</p></html>")
    assert title == "A & B" and text == "One\ntwoé"
    assert strip_html(None) == ("", "")


def test_cover_density():
    assert cover_density([(0, "a", 1.0), (4, "a", 0.4)], 1) == 1.4
    # one cover of two words side by side: 2 / (1 + 1)
    assert cover_density([(3, "a", 1.0), (4, "b", 1.0)], 2) == 1.0
    # with two words between, a third of it
    assert abs(cover_density([(3, "a", 1.0), (6, "b", 1.0)], 2) - 1 / 3) < 1e-12


def test_highlight(spark):
    from codexlake.operators.retrieval import highlight

    df = spark.createDataFrame([("no one here but The fox, the end",)], "v string")
    assert df.select(highlight(F.col("v"), "the", 4).alias("o")).first().o.count("<b>") == 2


def test_snippet_passes_over_the_nine_openings(spark):
    tail = " and so on, in a line that is long enough for a snippet of the page."
    skipped = ["Main article: x", "Main topic: x", "For other uses, see x", "Part of a series on x", "This article is about x", "Not to be confused with x", "This list is incomplete", "See also x", "In other words x"]
    taken = ["see also x", "FOR OTHER USES x", "From wikipedia x", "Coordinates: x", "Redirects here x", "May refer to x"]
    last = "The last line holds what the page is about, in fifty bytes and more."
    assert column(spark, [f"{s}{tail}\n{last}" for s in skipped], X.snippet("v")) == [last] * len(skipped)
    assert column(spark, [f"{s}{tail}\n{last}" for s in taken], X.snippet("v")) == [f"{s}{tail}" for s in taken]


def test_eta_beyond_doubles(spark):
    assert column(spark, ["9007199254740993", "-7", "7"], X.eta_seconds(F.col("v").cast("bigint"), F.lit(1).cast("bigint"))) == [9007199254740993, -7, 7]
