"""Upserts, filters, language and streams: replay, skew and loss-free behaviour."""

import math
import pathlib

import pytest
from pyspark.sql import functions as F

from pageloom.catalog import registry
from pageloom.catalog.views import Tables, as_of
from pageloom.functions import ratings, text, urls
from pageloom.operators import bloom, index, keyed_table, language, url_filters
from pageloom.schemas import PAGE_INDEX
from pageloom.session import fresh_path, stored
from pageloom.streaming import jobs as streams


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_upserts_twice_change_nothing(spark, folder):
    t = Tables(spark, folder)
    once = index.upsert_sources(t.some_sources(), t.pages)
    assert rows(index.upsert_sources(once, t.pages)) == rows(once)
    comments = stored(index.upsert_comments(t.stored_comments(), t.comments(), as_of()), "c")
    assert index.new_comments(comments, t.comments(), as_of()).count() == 0
    pages = stored(index.upsert_pages(t.stored_index(), t.index_docs(), t.sources(), t.profiles(), as_of()), "p")
    again = index.upsert_pages(pages, t.index_docs(), t.sources(), t.profiles(), as_of())
    assert rows(again.drop("cached_tag_list")) == rows(pages.drop("cached_tag_list"))


def test_null_comment_content_is_one_key(spark):
    schema = "page_url string, author string, title string, content string, published string, ord bigint"
    given = spark.createDataFrame([("u", "a", "t", None, None, 1), ("u", "b", "t", None, None, 2)], schema)
    empty = spark.createDataFrame([], "page_url string, author string, title string, content string, published timestamp_ntz")
    first = index.upsert_comments(empty, given, as_of())
    assert first.count() == 1
    assert index.new_comments(first, given, as_of()).count() == 0


def test_hot_url_is_folded_before_the_shuffle(spark):
    hot = spark.range(200_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'http://hot.example.com/' ELSE concat('http://h', id, '.example.com/') END AS url")
    out = url_filters.visited_url_filter(None, "id")(hot)
    assert out.count() == 200_000 - 66_667 + 1
    assert out.filter("url = 'http://hot.example.com/'").collect()[0].id == 0
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_top_words_equal_plain_ranking(spark, folder):
    docs = Tables(spark, folder).documents
    counts = language.build_lexicon(docs)
    plain = counts.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r").filter("r <= 50").drop("r")
    assert rows(language.build_lexicon(docs, top_k=50)) == rows(plain)


def test_bloom_has_no_false_negatives(spark, folder):
    lexicon = stored(language.build_lexicon(Tables(spark, folder).documents), "lex")
    hits = bloom.word_hits(lexicon, bloom.build(lexicon))
    missed = lexicon.join(hits.select("lang", "word", F.array_contains("langs", F.col("lang")).alias("ok")), ["lang", "word"], "left")
    assert missed.filter("NOT coalesce(ok, false)").count() == 0


def test_seen_urls_expire(spark, tmp_path):
    schema = "key string, ts timestamp"
    for i, (minute, key) in enumerate([(0, "a"), (1, "a"), (200, "b"), (400, "a"), (401, "a")]):
        spark.createDataFrame([(key, minute)], "key string, m int").selectExpr(
            "key", "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / f"f{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    out = streams.run_available(streams.seen_urls(stream, "key", "ts", "10 minutes"), "expire")
    assert out.count() == 3 and out.select("key").distinct().count() == 2


def test_stream_equals_batch(spark, folder):
    t = Tables(spark, folder)
    stream = streams.file_stream(spark, folder, "pages.parquet", "page_id bigint, url string, html string")
    batch = t.pages.select(urls.host_url("url").alias("host")).filter("host is not null").distinct()
    assert rows(streams.run_available(streams.seen_hosts(stream), "hosts")) == rows(batch)


def test_ratings_and_text_edges(spark):
    cases = [("4-5", 4), ("4,5-5", 4), ("8-10", 4), ("4", 4), ("4-0", None), ("", None), (None, None), ("-5", 0), ("x-5", 0)]
    df = spark.createDataFrame(cases, "value string, want bigint")
    for r in df.withColumn("got", ratings.parse_evaluation("value")).collect():
        assert r.got == r.want, r
    made = spark.createDataFrame([("&amp;lt; &#233;&#xE9;&bogus; & &eacute;",)], "v string")
    assert made.select(text.decode_entities("v")).collect()[0][0] == "&lt; éé&bogus; & é"
    raw = spark.createDataFrame([(bytearray(b"caf\xe9 \xa4"), "iso-8859-15", "café €"), (bytearray(b"a\xffb"), "utf-8", "ab"),
                                 (bytearray(b"caf\xe9"), None, "café"), (bytearray("é".encode()), "UTF-8", "é")], "b binary, cs string, want string")
    for r in raw.withColumn("got", text.to_utf8("b", F.coalesce("cs", F.lit("none")))).collect():
        assert r.got == r.want, r


def test_url_edges(spark):
    cases = [("HTTP://Ex.COM:80", None, "http://ex.com/"), ("https://u@Ex.com:443/a?x=1#f", None, "https://u@ex.com/a?x=1"),
             ("../b", "http://h.com/x/y/z", "http://h.com/x/b"), ("?q=1", "http://h.com/x?p", "http://h.com/x?q=1"),
             ("//o.com/p", "https://h.com/", "https://o.com/p"), ("/r", "http://h.com:8080/a/b", "http://h.com:8080/r"), ("leaf", "http://h.com", "http://h.com/leaf")]
    df = spark.createDataFrame(cases, "url string, ref string, want string")
    for r in df.withColumn("got", urls.normalize(urls.resolve("url", "ref"))).collect():
        assert r.got == r.want, r


def _wanted(batches, step=1):
    """Rows (k, v) after so many batches; batch n changes 5 keys of 40 and adds one."""
    out = {}
    for n in range(batches):
        out |= {(7 * n + i) % 40: n * 1000 + i for i in range(5)} | {1000 + n: n}
    return out


def _batch(spark, n):
    return spark.createDataFrame([((7 * n + i) % 40, n * 1000 + i) for i in range(5)] + [(1000 + n, n)], "k bigint, v bigint").coalesce(1)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_table_stays_in_few_folders(spark, tmp_path, monkeypatch, few_partitions):
    """75 batches with three to a level: what a batch reads stays few, every version is what it was, old folders go."""
    monkeypatch.setattr(keyed_table, "FANOUT", 3)
    empty = spark.createDataFrame([], "k bigint, v bigint")
    table = keyed_table.TableVersions(spark, str(tmp_path / "t"), empty, ("k",), buckets=2)
    for n in range(75):
        table.put(n, _batch(spark, n))
        levels = 1 + int(math.log(n + 1, 3) + 1e-9)
        assert len(table.read_at(n)) <= 2 * levels + 1, (n, table.read_at(n))
        if n % 15 == 14:
            assert dict(map(tuple, table.latest().collect())) == _wanted(n + 1)
            assert dict(map(tuple, table.before(n).collect())) == _wanted(n)
    assert len(table.folders()) < 25
    again = keyed_table.TableVersions(spark, str(tmp_path / "t"), empty, ("k",), buckets=2)
    assert dict(map(tuple, again.latest().collect())) == _wanted(75)


@pytest.mark.parametrize("moment", ["merged", "written", "half written"])
def test_a_crash_counts_nothing_twice(spark, tmp_path, monkeypatch, few_partitions, moment):
    """Stopped after the merge, after the rows of the batch, or in the middle of a folder: the batch is run again."""
    monkeypatch.setattr(keyed_table, "FANOUT", 3)
    empty = spark.createDataFrame([], "k bigint, v bigint")
    root = tmp_path / "t"
    for n in range(20):
        table = keyed_table.TableVersions(spark, str(root), empty, ("k",), buckets=2)
        if n % 3 == 0:      # a first try that ends early
            table.merge(n)
            if moment == "written":
                table.put(n, _batch(spark, n).withColumn("v", F.col("v") + 5))
            if moment == "half written" and n:
                for half in (f"rows={n}-{n}", f"rows={n - 3}-{n - 1}"):
                    if (root / half / "_SUCCESS").exists():
                        (root / half / "_SUCCESS").rename(root / half / "gone")
        table.put(n, _batch(spark, n))
    assert dict(map(tuple, table.latest().collect())) == _wanted(20)


def test_versions_go_on_after_a_restart(spark, tmp_path):
    """Four small files; stopped after two; new objects go on. What a batch writes doesn't grow with the table."""
    source, root, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    empty = spark.createDataFrame([], "k bigint, v bigint")

    def land(n, first):
        spark.range(first, first + 50).selectExpr("id % 120 AS k", f"{n} * 1000 + id AS v").coalesce(1).write.parquet(str(source / f"f{n}"))

    def run():
        table = keyed_table.TableVersions(spark, root, empty, ("k",))
        stream = spark.readStream.schema("k bigint, v bigint").option("maxFilesPerTrigger", 1).option(
            "recursiveFileLookup", "true").parquet(str(source))
        streams.run_batches(stream, "restart", lambda batch, n: table.put(n, batch), state=state).awaitTermination()
        return table
    land(0, 0)
    land(1, 40)
    run()
    land(2, 80)
    land(3, 0)
    table = run()
    wanted = {}
    for n, first in enumerate((0, 40, 80, 0)):
        wanted |= {i % 120: n * 1000 + i for i in range(first, first + 50)}
    assert dict(map(tuple, table.latest().collect())) == wanted
    assert [spark.read.parquet(f"{root}/rows={n}-{n}").count() for n in range(4)] == [50, 50, 50, 50]


def test_an_upsert_writes_what_changes(spark, folder):
    """A known page costs nothing if nothing is said about it, a mark costs its row; bytes written don't grow with the index."""
    t = Tables(spark, folder)
    columns = PAGE_INDEX.fieldNames()
    docs = t.index_docs()

    def written(copies):
        table = keyed_table.TableVersions(spark, fresh_path(spark, "grow"), spark.createDataFrame([], PAGE_INDEX), ("url",), buckets=64)
        old = t.stored_index().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(
            "url", F.when(F.col("n") > 1, F.concat("url", F.lit("?copy="), F.col("n").cast("string"))).otherwise(F.col("url")))
        table.add(0, old.select(columns))
        one = docs.filter("ord = (SELECT min(page_id) FROM pages)")
        table.add(1, index.index_changes(table, 1, one, t.sources(), t.profiles(), as_of()))
        plan = table.keys_before(2, one)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
        files = list(pathlib.Path(table.root, "rows=1-1").rglob("*.parquet"))
        return sum(f.stat().st_size for f in files), len(files)
    t.pages.createOrReplaceTempView("pages")
    small, large = written(1), written(40)
    assert small == large and small[1] <= 1


def test_hosts_on_disk_go_on_after_a_restart(spark, tmp_path):
    """The set of seen hosts lies on disk and is exact over restarts."""
    schema, kept = "url string", {k: spark.conf.get(k, None) for k in streams.ON_DISK}
    streams.state_on_disk(spark)
    try:
        for n in range(3):
            spark.range(40 * n, 40 * n + 60).selectExpr("concat('http://h', id % 90, '.example.com/', id) AS url").coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            out = streams.run_available(streams.seen_hosts(stream), "hosts", state=str(tmp_path / "state"), out=str(tmp_path / "out"))
        assert out.count() == out.distinct().count() == 90
        assert list((tmp_path / "state").rglob("*.zip")), "state is kept by the store on disk"
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_frequent_words_are_not_shuffled(spark, monkeypatch):
    """One word is in all texts. It is looked up where it is read; what is shuffled by word are rare ones, evenly."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('the word', id, ' of the word', id % 5000, ' THE end') AS text")
    lexicon = stored(language.build_lexicon(docs), "lexicon")
    monkeypatch.setattr(language, "HEAVY", 10)
    toks = language.tokens(docs)
    heavy = {r["word"] for r in language.heavy_words(toks).collect()}
    assert {"the", "of", "end"} <= heavy and len(heavy) == 10
    far = toks.filter(~F.col("word").isin(*heavy)).select(F.expr("pmod(hash(word), 8)").alias("p")).groupBy("p").count().collect()
    counts = sorted(r["count"] for r in far)
    assert counts[-1] <= 2 * counts[len(counts) // 2]
    hits = language.lexicon_hits(toks, lexicon)
    assert hits.count() == toks.count() == 20_000 * 7
    assert rows(language.hit_counts(hits).groupBy("hits").count()) == ["Row(count=20000, hits=7)"]
    left = language.lexicon_hits(toks, lexicon.filter("word <> 'the'"), "left")
    assert left.filter("langs IS NULL").count() == 60_000

@pytest.fixture
def table_folders(spark, folder, tmp_path):
    """The pages as a table that is a folder of three files."""
    spark.read.parquet(f"{folder}/pages.parquet").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_the_loop_reads_a_table_of_several_files(spark, folder, table_folders):
    for where in (folder, table_folders):
        found = registry.QUERIES["t4_repeat_loop"](spark, where)
        assert rows(found) == rows(spark.read.parquet(f"{folder}/pages.parquet").select("page_id"))
    hosts = registry.QUERIES["t1_seen_hosts"]
    assert rows(hosts(spark, table_folders)) == rows(hosts(spark, folder))


def test_extraction_streams_a_table_of_several_files(spark, folder, table_folders):
    found = registry.QUERIES["t7_stream_extraction"]
    assert rows(found(spark, table_folders)) == rows(found(spark, folder)) != []


def test_frequent_words_are_not_hashed_where_they_are_read(spark):
    docs = spark.createDataFrame([(i, "ein wort") for i in range(50)], "doc_id bigint, text string")
    hits = bloom.word_hits(language.tokens(docs), bloom.build(language.build_lexicon(docs.selectExpr("'de' AS lang", "text"))))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "sha1" in x]


def places(df):
    """The number of tasks that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_queue_has_tasks_by_its_rows(spark, monkeypatch):
    """More results are more tasks, not larger ones; repeats and unknown keywords are dropped as ever."""
    from pageloom import session
    from pageloom.operators import crawl
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    tasks = spark.range(100).selectExpr("id AS scrape_id", "'k' AS keyword", "id % 3 AS profile_id", "'t' AS profile_title", "id % 5 AS source_id", "'http://s/' AS source_url")
    results = spark.range(800).selectExpr("id % 100 AS scrape_id", "IF(id % 400 < 300, 'k', 'x') AS keyword", "concat('http://a/', id % 400) AS url")
    queue = crawl.result_queue(tasks, results)
    assert sorted(r[0] for r in queue.select("url").collect()) == sorted(f"http://a/{i}" for i in range(300))
    assert places(queue) > 20


def test_early_exit_folds_ends_alone(spark):
    """Reading stops at the first fourth word with a clear lead, else at the end; other words aren't folded, and none is ranked by a sort."""
    from pageloom.operators import language
    seen = spark.createDataFrame(
        [(1, p, ["en"] if p != 2 else ["fr"]) for p in range(1, 21)] + [(2, p, ["fr"]) for p in range(1, 7)] + [(3, 1, None), (3, 2, ["de", "en"])] + [(4, 1, None)],
        "doc_id long, pos int, langs array<string>")
    out = language.early_exit_counts(seen, ["en", "fr", "de"])
    assert sorted(map(tuple, out.collect())) == [(1, "en", 7, 8), (1, "fr", 1, 8), (2, "fr", 6, 6), (3, "de", 1, 2), (3, "en", 1, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "Filter" in plan[plan.index("min_by"):plan.index("Window")]


def test_stages_are_written_small(spark):
    """Files of a run's stages hold texts, so they are written with zstd."""
    import pyarrow.parquet as pq
    from pageloom.operators import metrics
    out = metrics.StageLog().written(spark.range(5).coalesce(1).withColumn("html", F.lit("x")), "stage")
    kinds = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(1).compression for f in out.inputFiles()}
    assert kinds == {"ZSTD"} and out.count() == 5
