import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from textpulse.operators import clean
from textpulse.sources import articles, items, pages, store
from textpulse.streaming import refresh

SNIPPET = {"channelId": "c1", "title": "T\"1", "description": "line\none", "publishedAt": "2020-05-01T10:00:00Z"}


def _documents(spark):
    docs = [
        {"kind": items.LIST_KIND, "items": [{"id": "v1", "snippet": SNIPPET}, {"id": "v9", "snippet": SNIPPET}], "playlist": {}},
        {"kind": "item", "id": "v2", "snippet": SNIPPET, "playlist": {"snippet": {"title": "P"}}},
        {"kind": "item", "id": "v3", "playlist": {}},
        {"kind": items.LIST_KIND, "items": [], "playlist": {}},
        {"kind": "item", "id": "v4", "snippet": SNIPPET},
    ]
    return items.parse_items(spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",)], "json string"))


def test_flatten_both_shapes(spark, rows):
    got = rows(items.flatten_items(_documents(spark)).select("item_id", "playlist", "title", "description", "url"))
    assert got == [("v1", "", "T\"1", "line\none", "www.youtube.com/watch?v=v1"), ("v2", "P", "T\"1", "line\none", "www.youtube.com/watch?v=v2")]


def test_malformed_documents_are_kept_apart(spark):
    assert items.malformed_items(_documents(spark)).count() == 4


def test_quarantine_keeps_key_and_text(spark, rows, tmp_path):
    from textpulse.plans import jobs
    good = {"kind": "item", "id": "v1", "snippet": SNIPPET, "playlist": {}}
    dated = good | {"snippet": SNIPPET | {"publishedAt": "yesterday"}}
    raw = [(1, json.dumps(good)), (2, "not json"), (3, json.dumps(dated)), (4, None)]
    flat = jobs.flatten(spark.createDataFrame(raw, "doc_id long, json string"), str(tmp_path))
    assert rows(flat.select("item_id")) == [("v1",)]
    assert rows(spark.read.parquet(f"{tmp_path}/quarantine")) == sorted(raw[1:], key=str)


def test_items_from_json_files(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"kind": "item", "id": "v2", "snippet": SNIPPET, "playlist": {}}) + "\n")
    row = items.flatten_items(items.read_items(spark, str(path))).first()
    assert row.item_id == "v2" and row.published_at == dt.datetime(2020, 5, 1, 10)


def test_unknown_group_becomes_null_and_drops(spark, rows):
    table = spark.createDataFrame([("v1", "c1"), ("v2", "c2")], "item_id string, grp_id string")
    names = spark.createDataFrame([("c1", "ONE")], "grp_id string, grp string")
    looked = items.group_lookup(table, names)
    assert rows(looked.select("item_id", "grp")) == [("v1", "ONE"), ("v2", None)]
    assert rows(clean.drop_nulls(looked).select("item_id")) == [("v1",)]


def test_recent_window_and_limit(spark, rows):
    now = dt.datetime(2024, 1, 31)
    events = spark.createDataFrame([(i, now - dt.timedelta(days=i)) for i in range(-1, 20)], "event_id long, ts timestamp")
    assert rows(items.ingest_recent(events, now, 14, 3).select("event_id")) == [(0,), (1,), (2,)]
    assert items.ingest_recent(events, now, 14, None).count() == 15


def test_parent_is_null_when_unknown(spark, rows):
    children = spark.createDataFrame([(1, 7), (2, 8)], "id long, p long")
    parents = spark.createDataFrame([(7, "x")], "pid long, name string")
    joined = items.attach_parent(children, parents, "p", "pid")
    assert rows(joined.select("id", "parent.name")) == [(1, "x"), (2, None)]


def test_csv_keeps_awkward_text(spark, rows, tmp_path):
    table = spark.createDataFrame([(1, ' a "q", b\nc '), (2, "x\\y"), (3, None), (4, "plain")], "k long, t string")
    articles.write_csv(table, str(tmp_path / "out"))
    assert rows(articles.read_csv(spark, str(tmp_path / "out"), "k BIGINT, t STRING")) == rows(table)


def test_failed_pages(spark, rows):
    table = spark.createDataFrame([(1, "ok"), (2, "a 403 b"), (3, None), (4, "is Forbidden"), (5, "FAILED_TO_LOAD_PAGE")], "k long, text string")
    assert rows(articles.without_failed_pages(table).select("k")) == [(1,), (3,)]


def test_backfill_prefers_metadata(spark, rows):
    stored = spark.createDataFrame([("u1", None, "old"), ("u2", "b2", None)], "url string, bias string, quality string")
    meta = spark.createDataFrame([("u1", "new", None)], "url string, bias string, quality string")
    assert rows(articles.backfill(stored, meta, "url", ["bias", "quality"])) == [("u1", "new", "old"), ("u2", "b2", None)]


HTML = ('<html><head><title>T &amp; U</title><style>p{}</style><script>var x = "<article>no</article>";</script></head><body>'
        '<!-- c --><a href="/one">1</a><div class="x post"><div>in<br>ner</div> end</div><article>A<p>b<i>c</article>'
        '<article>second</article><a rel="n" href="/two?a=1">2</a></body>')


def test_pages(spark, rows):
    table = spark.createDataFrame([(1, HTML), (2, "<p>plain"), (3, None)], "page_id long, html string")
    assert rows(pages.page_text(table)) == [(1, "T & U1inner endAbcsecond2"), (2, "plain"), (3, articles.FAILED_MARKER)]
    assert rows(pages.page_content(table)) == [(1, "Abc")]
    assert rows(pages.page_content(table, "div.post")) == [(1, "inner end")]
    assert rows(pages.page_links(table)) == [(1, 0, "/one"), (1, 1, "/two?a=1")]


def test_links_by_selector(spark, rows):
    html = ("<nav><a href='/nav'>n</a></nav><div class='list big'><h2><a href=\"/a?x=1&amp;y=2\">A</a></h2><p><h2><a href=/b>B</a>"
            "<br><span><a href='/deep'>D</a></span></h2></div><div class=other><h2><a href='/c'>C</a></h2></div><a>none</a>")
    table = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert rows(pages.page_links(table, "div.list h2 > a")) == [(1, 0, "/a?x=1&y=2"), (1, 1, "/b")]
    assert rows(pages.page_links(table, ".big a")) == [(1, 0, "/a?x=1&y=2"), (1, 1, "/b"), (1, 2, "/deep")]
    assert rows(pages.page_links(table, "nav > a")) == [(1, 0, "/nav")]


def test_pages_leave_the_task_some_at_a_time(spark, rows):
    """A task never holds the strings of a whole Arrow batch."""
    table = spark.createDataFrame([(i, None if i == 7 else f"<p>{i}</p><a href='{i}'>x</a>") for i in range(150)], "page_id long, html string")
    assert rows(pages.page_text(table)) == rows(spark.createDataFrame(
        [(i, articles.FAILED_MARKER if i == 7 else f"{i}x") for i in range(150)], "page_id long, text string"))
    seen = []

    class Captured:
        schema = table.schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            seen.extend(run(iter(table.toArrow().combine_chunks().to_batches())))
            return table

    pages.page_text(Captured())
    assert [len(b) for b in seen] == [64, 64, 22]


def test_fingerprint(spark):
    url = "http://é.example/"
    got = spark.createDataFrame([(url,)], "u string").select(pages.fingerprint(F.col("u"))).first()[0]
    assert got == hashlib.sha224(url.encode()).hexdigest()


def test_fingerprints_of_all_pages(spark):
    """SQL has no SHA-224, so the query over the given pages is held against the standard library's."""
    from textpulse.plans.recipes import QUERIES
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r.key for r in QUERIES["url_fingerprint"](spark, folder).collect()}
    want = {r.page_id: hashlib.sha224(r.url.encode()).hexdigest() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert got == want and len(got) > 10


def test_merge_is_per_field(spark, rows):
    old = spark.createDataFrame([("k1", 1, "a", "x"), ("k2", 1, "b", "y")], "k string, v int, f string, g string")
    new = spark.createDataFrame([("k1", 2, "c"), ("k3", 2, "d")], "k string, v int, f string")
    got = rows(store.merge_latest(old, new, ["k"], ["v"]).select("k", "f", "g", "v"))
    assert got == [("k1", "c", "x", 2), ("k2", "b", "y", 1), ("k3", "d", None, 2)]
    again = store.merge_latest(store.merge_latest(old, new, ["k"], ["v"]), new, ["k"], ["v"])
    assert rows(again.select("k", "f", "g", "v")) == got


def test_store_read_append_delete(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([("x", "a", 1.0), ("y", "a", 2.0)], "term string, grp string, v double")
    store.write_by_term(table, path)
    store.append(table.where("term = 'x'"), path)
    assert len(rows(store.read_terms(spark, path, ["x"]))) == 2 and rows(store.read_terms(spark, path, ["z"])) == []
    plan = store.read_terms(spark, path, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,x)]" in plan
    assert rows(store.delete_keys(table, table.where("term = 'x'"), "term").select("term")) == [("y",)]


def test_filters(spark, rows):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "g1 string, g2 string")
    assert rows(clean.pairs_touching(pairs, ["a"])) == [("a", "b")]
    assert len(rows(clean.pairs_touching(pairs, ["a", "All"]))) == 3
    assert rows(clean.pair_groups(pairs)) == [("a",), ("b",), ("c",)]
    table = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "grp string, v int")
    assert rows(clean.in_groups(table, ["b"])) == [("b", 3)] and clean.in_groups(table, None) is table
    assert rows(clean.first_per(table, "grp", ["v"])) == [("a", 1), ("b", 3)]
    assert rows(clean.first_n(table, 2, "v")) == [("a", 1), ("a", 2)] and clean.first_n(table, None, "v").count() == 3
    assert rows(clean.group_doc_counts(table)) == [("a", 2), ("b", 1)]
    assert clean.dedupe(table.union(table)).count() == 3


EVENTS = "event_id long, ts timestamp, user_id long, v double"


def _stream(spark, folder, batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_stream_upsert_over_batches_and_restart(spark, rows, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    stream = _stream(spark, tmp_path / "in", [[(1, at(1), 7, 1.0), (2, at(2), 8, 2.0)], [(1, at(1), 7, 1.0), (3, at(3), 7, 3.0)]])
    target = str(tmp_path / "snap")
    final = refresh.stream_upsert(stream, ["user_id"], ["ts", "event_id"], target=target)
    assert rows(final.select("user_id", "v")) == [(7, 3.0), (8, 2.0)]
    spark.createDataFrame([(4, at(4), 8, 4.0)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / "b9"))
    again = refresh.stream_upsert(stream, ["user_id"], ["ts", "event_id"], target=target)
    assert rows(again.select("user_id", "v")) == [(7, 3.0), (8, 4.0)]


def test_stream_upsert_keeps_late_rows_and_drops_old_files(spark, rows, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    stream = _stream(spark, tmp_path / "in", [
        [(1, at(20), 7, 1.0)], [(2, at(2), 9, 2.0), (3, at(1), 7, 3.0)], [(4, at(21), 7, 4.0)], [(5, at(3), 5, 5.0)], [(5, at(3), 5, 5.0)]])
    target = tmp_path / "snap"
    final = refresh.stream_upsert(stream, ["user_id"], ["ts", "event_id"], target=str(target), buckets=2)
    assert rows(final.select("user_id", "v")) == [(5, 5.0), (7, 4.0), (9, 2.0)]  # 9 came 18 days late, under a new key
    assert len(list((target / "manifest").glob("v*"))) == 2


def test_late_rows_do_not_count(spark, rows, tmp_path):
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    stream = _stream(spark, tmp_path / "in", [
        [(1, day(1), 1, 1.0), (2, day(5), 1, 5.0)], [(3, day(5, 2), 1, 7.0)], [(4, day(1), 1, 9.0), (5, day(8), 1, 8.0)]])
    daily = refresh.run_to_table(refresh.daily_statistics(stream, "user_id", "v"))
    assert rows(daily.select("day", "n", "avg_value")) == [(dt.date(2024, 1, 1), 1, 1.0), (dt.date(2024, 1, 5), 2, 6.0)]
