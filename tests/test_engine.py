"""The engine, the command line, and the driver-side parts."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lexiloom import cli, runtime, settings
from lexiloom.engine import Engine
from lexiloom.functions import tables
from lexiloom.operators import answers, extraction, graph, rollup, vector
from lexiloom.sources import http, sessions
from lexiloom.sources.clients import HashEmbedder, ScriptedChat
from lexiloom.sources.store import PageCache, Versioned

PAGES = [
    (1, "https://kb.example.org/ledger/intro", "<html><head><title>Ledger intro</title></head><body><main><h1>Ledger</h1><p>The ledger keeps every transfer. Orchid writes the ledger.</p><a href='/ledger/rotate'>rotate</a></main></body></html>"),
    (2, "https://kb.example.org/ledger/rotate", "<html><head><title>Rotation</title></head><body><main><h1>Rotating segments</h1><p>Segments rotate nightly. Rotated segments are sealed by Walnut.</p></main></body></html>"),
    (3, "https://kb.example.org/api/raw", "<h1>Raw</h1><p>nothing to see"),
]
SCHEMA = "page_id long, url string, html string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, SCHEMA)


def cites(prompt):
    if "[CHUNK:" not in prompt:
        return "ready"
    return f"It rotates {prompt[prompt.index('[CHUNK:'):].split(']')[0]}]."


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), HashEmbedder(), ScriptedChat(cites), settings.Settings(embedding_batch_delay=0.0))
    assert e.ingest(pages(spark)) == {"new": 3, "changed": 0, "same": 0}
    return e


def test_ingest_again(spark, engine):
    assert engine.ingest(pages(spark)) == {"new": 0, "changed": 0, "same": 3}
    n = engine.stats()
    assert n["pages"] == 3 and n["chunks"] > 3 and n["embedded"] == n["chunks"]


def test_query(engine):
    got = engine.query("When do segments rotate?")
    assert got["answer"].startswith("It rotates [CHUNK:") and len(got["valid_citations"]) == 1 and not got["used_fallback"] and got["sources"][0].endswith("/rotate")
    assert engine.query(" when do segments ROTATE? ")["cached"] and engine.cache.stats()["hits"] == 1
    for bad in ("", "x" * 10_001):
        with pytest.raises(ValueError):
            engine.query(bad)
    log = engine.analytics()
    assert log["total_queries"] == 1 and log["answers_generated"] == 1 and sum(log["by_type"].values()) == 1
    engine.log_query("q", "factual", [], [], 0.5, False)
    assert engine.log.count() == 2


def test_without_model(spark, engine):
    plain = Engine(spark, engine.root)
    got = plain.query("When do segments rotate?")
    assert got["answer"] == answers.NOT_CONFIGURED or got["used_fallback"]
    failing = Engine(spark, engine.root, chat=ScriptedChat(lambda p: 1 / 0))
    assert failing.query("When do segments rotate?")["used_fallback"]
    with pytest.raises(ValueError):
        plain.backfill()


def test_graph_and_summaries(spark, engine, tmp_path):
    terms = spark.createDataFrame([("Orchid", "service", ""), ("Walnut", "service", ""), ("Unseen thing", "x", "")], "name string, type string, description string")
    find = extraction.dictionary_extractor(terms)
    first = engine.extract_entities(find)
    assert first["entities"] == 2 and first["links"] >= 2
    assert engine.extract_entities(find) == first
    said = {"entities": [{"name": "Orchid", "type": "service"}, {"name": "Ledger", "type": "store"}, {"name": "", "type": "x"}], "relationships": [{"source": "Orchid", "target": "Ledger", "type": "writes"}, {"source": "Orchid", "target": "Nobody", "type": "writes"}]}
    some = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, text string")
    chunks = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "doc_id long, page_id long")
    none = (graph.resolve_entities(spark.createDataFrame([], "name string, type string, description string, ord long")), spark.createDataFrame([], "source_id long, target_id long, type string, description string"), spark.createDataFrame([], "doc_id long, entity_id long"))
    chat = ScriptedChat(lambda p: f"```json\n{json.dumps(said)}\n```" if p.endswith("a") else "no")
    entities, edges, links = extraction.extract_graph(some, chunks, *none, extraction.chat_extractor(chat))
    assert sorted(r["name"] for r in entities.collect()) == ["Ledger", "Orchid"] and edges.count() == 1
    assert {r["doc_id"] for r in links.collect()} == {10, 11}
    assert engine.export_graph(str(tmp_path / "graph"))["entities"] == 2
    done = engine.rebuild_summaries()
    assert done["errors"] == [] and done["page_summaries"] == 3 and done["global_summary"] == 1
    assert engine.page_summaries().count() == 3


def test_validate_and_health(spark, engine):
    assert not any(engine.validate().values())
    bad = Engine(spark, engine.root, chat=ScriptedChat(lambda p: 1 / 0))
    kept = engine.vectors
    engine._replace("embeddings", kept.unionByName(spark.createDataFrame([(-1, [1.0])], "vec_id long, embedding array<float>")))
    assert engine.validate(fix=True)["vectors without a chunk"] == 1 and not any(engine.validate().values())
    assert bad.health()["status"] == "unhealthy" and Engine(spark, engine.root).health()["status"] == "healthy"


def test_cli(engine, tmp_path):
    def run(*args, lines=""):
        out = io.StringIO()
        code = cli.run(engine, cli.parser().parse_args(["--root", engine.root, *args]), out, io.StringIO(lines))
        return code, out.getvalue()

    code, said = run("bm25", "sealed segments", "--json")
    assert code == 0 and json.loads(said)[0]["url"].endswith("/rotate")
    for args in (("stats", "--json"), ("health", "--json"), ("analytics", "--json"), ("cache", "stats", "--json"), ("crawl-sessions", "--json"), ("validate", "--json"), ("backfill", "--json"), ("resume-embeddings", "--json"), ("summarize-pages", "--json"), ("export-graph", "-o", str(tmp_path / "g"), "--json")):
        code, said = run(*args)
        json.loads(said)
        assert code == 0, args
    assert run("rebuild-index")[0] == 0 and run("analytics", "--export", str(tmp_path / "log"))[0] == 0
    assert "It rotates" in run("interactive", lines="help\nstats\ncache\n\nWhen do segments rotate?\nquit\nnever\n")[1]
    assert cli.parse_line(" EXIT ") == ("quit", "") and cli.parse_line("what is a seal") == ("query", "what is a seal")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--root", "x", "unknown"])


class Site:
    """Pages by url; urls in ``broken`` fail so many times first."""

    def __init__(self, pages, broken=None):
        self.pages, self.broken, self.asked = pages, broken or {}, []

    def __call__(self, url, data, headers, timeout):
        self.asked.append(url)
        if self.broken.get(url, 0) > 0:
            self.broken[url] -= 1
            return 503, b"", {"Retry-After": "2"}
        return (200, self.pages[url].encode(), {}) if url in self.pages else (404, b"", {})


def test_crawl(spark, tmp_path):
    site = {u: h for _, u, h in PAGES} | {"https://kb.example.org/robots.txt": "User-agent: *\nDisallow: /ledger/secret", "https://kb.example.org/ledger/rotate": PAGES[1][2] + "<a href='/ledger/secret'>s</a><a href='/ledger/intro'>i</a><a href='https://other.example.org/'>o</a>"}
    s = settings.Settings(crawl_delay_seconds=0.0, crawler_retry_delay=0.0)
    e = Engine(spark, str(tmp_path), settings=s, http=http.Http(Site(site), 2, 0.0))
    got = e.crawl("https://kb.example.org/ledger/intro", max_pages=1)
    assert got["crawled"] == 1 and got["new"] == 1
    e.sessions.record(got["session_id"], status="interrupted")
    more = e.crawl("https://kb.example.org/ledger/intro")
    assert more["session_id"] == got["session_id"] and more["crawled"] == 1 and more["failed"] == 0 and more["skipped"] == 2
    row = e.sessions.listed().first()
    assert (row["status"], row["pages_crawled"], row["queued"]) == ("completed", 2, 0)
    assert e.crawl("https://kb.example.org/ledger/intro", fresh=True)["same"] == 2
    with pytest.raises(ValueError):
        e.crawl("http://10.0.0.1/")


def test_http():
    slept = []
    h = http.Http(Site({"u": "a"}, {"u": 2}), 4, 1.0, sleep=slept.append)
    assert h.get("u") == (200, "a") and slept == [2.0, 2.0]
    with pytest.raises(http.HttpError) as e:
        h.get("missing")
    assert e.value.status == 404 and len(slept) == 2
    reply = lambda body: http.Http(lambda *a: (200, json.dumps(body).encode(), {}))
    assert http.HttpEmbedder("e", reply({"embeddings": [[1.0], [2.0]]})).embed(["a", "b"]) == [[1.0], [2.0]]
    assert http.ListedEmbedder("e", "m", reply({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})).embed(["a", "b"]) == [[1.0], [2.0]]
    assert http.HttpChat("c", reply({"response": 'x ```json\n{"a": 1}\n```'})).complete_json("p") == {"a": 1}
    assert http.MessagesChat("c", "m", reply({"choices": [{"message": {"content": "hi"}}]})).complete("p", "s") == "hi"
    with pytest.raises(ValueError):
        http.HttpEmbedder("e", reply({"embeddings": []})).embed(["a"])
    assert http.basic_token("ann", "pw") == "YW5uOnB3"


def test_settings(tmp_path):
    s = settings.Settings.from_env({"LEXILOOM_MAX_PAGES": "7", "LEXILOOM_AI_ENABLED": "yes", "LEXILOOM_EXCLUDED_PATHS": "/a/, /b/"})
    assert s.max_pages == 7 and s.ai_enabled and s.excluded_paths == ("/a/", "/b/") and settings.problems(s) == []
    with pytest.raises(ValueError, match="LEXILOOM_MAX_PAGES"):
        settings.Settings.from_env({"LEXILOOM_MAX_PAGES": "many"})
    bad = settings.Settings(max_pages=0, chunk_overlap=-1, small_chunk_size=3000, vector_weight=0.9, basic_auth_enabled=True, query_cache_size=0, bm25_b=2.0)
    assert len(settings.problems(bad)) == 7 and len(settings.problems(settings.Settings(), require_apis=True)) == 4
    f = tmp_path / ".env"
    f.write_text("# c\nA=1\nB = 'x y'\nnothing\nC=3\n")
    env = {"C": "9"}
    assert settings.load_env(str(f), env) == {"A": "1", "B": "x y"} and env["C"] == "9" and settings.load_env(str(tmp_path / "none"), env) == {}


def test_cache_metrics_health_shutdown():
    now = [0.0]
    c = runtime.AnswerCache(2, 10, lambda: now[0])
    for k in "abc":
        c.put(k, k)
    assert c.get("a") is None and c.get("b") == "b"
    c.put("d", 1)
    assert c.get("c") is None and c.delete("d") and not c.delete("d")
    now[0] = 11
    assert c.cleanup() == 1 and c.stats()["hit_rate"] == round(1 / 3, 4) and c.stats()["evictions"] == 2
    one = runtime.AnswerCache(1, 0)
    one.put("a", 1)
    one.put("a", 2)
    assert one.get("a") == 2 and one.evictions == 0
    m = runtime.Metrics()
    with pytest.raises(ZeroDivisionError), runtime.timed("t", m):
        1 / 0  # noqa: B018
    m.record("v", 1)
    m.record("v", 3)
    assert m.aggregates()["v"] == {"count": 2, "min": 1, "max": 3, "avg": 2, "total": 4} and m.aggregates()["t"]["count"] == 1
    got = runtime.Health({"good": lambda: "fine", "none": lambda: None, "bad": lambda: 1 / 0}).report()
    assert got["status"] == "unhealthy" and [r["status"] for r in got["checks"]] == ["healthy", "skipped", "unhealthy"]
    s, ran = runtime.Shutdown(), []
    for f in (lambda: ran.append(1), lambda: 1 / 0, lambda: ran.append(3)):
        s.register(f)
    assert len(s.cleanup()) == 1 and ran == [3, 1] and s.cleanup() == []
    with pytest.raises(SystemExit) as e:
        s._terminated(15)
    assert e.value.code == 143
    out = io.StringIO()
    runtime.log_with(runtime.logger("lexiloom.test", style="json", stream=out), 20, "hello", page=3)
    assert json.loads(out.getvalue())["page"] == 3


def test_state_tables(spark, tmp_path):
    s = sessions.CrawlSessions(spark, str(tmp_path / "s"))
    sid = s.open("http://e.org/")
    assert s.enqueue(sid, spark.createDataFrame([("http://e.org/",), ("http://e.org/b",), ("http://e.org/a",)], "url string")) == 2
    assert s.take(sid, 2) == ["http://e.org/", "http://e.org/a"] and s.take(sid, 5) == ["http://e.org/b"] and s.take(sid) == []
    s.record(sid, crawled=2, status="interrupted")
    assert s.open("http://e.org/") == sid and s.open("http://e.org/", fresh=True) != sid
    with pytest.raises(ValueError):
        s.record(sid, status="odd")
    j = sessions.EmbeddingJobs(spark, str(tmp_path / "j"))
    job = j.start(5)
    assert j.unfinished().count() == 1
    j.update(job, 5, 0, "completed")
    assert j.get(job)["done"] == 5 and j.unfinished().count() == 0 and j.get("none") is None


def test_versions(spark, tmp_path):
    import os

    root = str(tmp_path / "t")
    v = Versioned(spark, root)
    assert v.read() is None
    for n in (1, 2, 3):
        v.write(spark.range(n))
        assert v.read().count() == n
    assert len([x for x in os.listdir(root) if x.startswith("v-")]) == 2
    late = Versioned(spark, root)
    late._pointers = lambda: [(2, "CURRENT-000000000002")]  # has not seen the third version
    with pytest.raises(RuntimeError):
        late.point_to(["v-x"])
    assert v.read().count() == 3


def test_page_cache(spark, tmp_path):
    c = PageCache(spark, str(tmp_path), buckets=2)
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert c.misses(urls).count() == 3 and c.get(urls).count() == 0
    c.put(spark.createDataFrame([("a", "one", 200), ("b", None, 200)], "url string, content string, status_code int"))
    assert {r["url"] for r in c.misses(urls).collect()} == {"b", "c"}
    c.put(spark.createDataFrame([("a", "two", 200), ("c", "x", 200)], "url string, content string, status_code int"))
    assert sorted((r["url"], r["content"]) for r in c.get(urls).collect()) == [("a", "two"), ("c", "x")]


def test_vector_index(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    x = vector.VectorIndex(spark, str(tmp_path))
    assert not x.fresh(v) and x.get(v).count() == 5 and x.fresh(v)
    changed = v.withColumn("embedding", F.when(F.col("vec_id") == 2, F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.col("embedding")))
    assert not x.fresh(changed)
    assert x.add(spark.createDataFrame([(2, [0.0, 0.0]), (9, [1.0, 1.0])], "vec_id long, embedding array<double>")).count() == 6
    assert x.remove(spark.createDataFrame([(9,), (77,)], "vec_id long")).count() == 5
    x.clear()
    assert x.load().count() == 0


def test_table_functions(spark):
    tables.register(spark)
    md = spark.createDataFrame([(1, "# Alpha\nfirst words\n## Beta\nmore words")], "id long, md string")
    md.createOrReplaceTempView("marked")
    got = spark.sql("select id, s.heading_path from marked, lateral split_markdown(md) s order by position").collect()
    assert [r["heading_path"] for r in got] == ["Alpha", "Alpha > Beta"]
    assert spark.sql("select * from chunk_text('one two three. four five six.', 12, 2)").count() > 1
    assert spark.sql("select * from chunk_tokens('one two three four five six', 3, 1)").count() > 1
    assert {r["chunk_type"] for r in spark.sql("select c.* from marked, lateral chunk_markdown(md) c").collect()} == {"large", "small"}


def test_model_questions(spark):
    q = spark.createDataFrame([(1, "Where is the seal kept?"), (2, "crash of the writer")], "query_id long, text string")
    kinds = {r["query_id"]: r["query_type"] for r in answers.classified(q, ScriptedChat(lambda p: " Exploratory " if "seal" in p else "odd")).collect()}
    assert kinds == {1: "exploratory", 2: "troubleshooting"}
    made = {r["query_id"]: r["variations"] for r in answers.expanded(q, ScriptedChat(lambda p: "first\n\n second \nfirst" if "seal" in p else 1 / 0)).collect()}
    assert made[1] == ["Where is the seal kept?", "first", "second"] and made[2][0] == "crash of the writer"


def test_rollup_is_whole(spark):
    rows = [(i, "s", f"t{i}", f"line {i}") for i in range(2500)] + [(9000, "s", "t", ""), (9001, "u", None, None)]
    parts = rollup.system_rollup(spark.createDataFrame(rows, "page_id long, system string, title string, summary string"))
    text = "\n".join(r["content"] for r in parts.filter("system = 's'").orderBy("part").collect() if r["content"])
    assert text.split("\n") == [f"- t{i}: line {i}" for i in range(2500)]
    assert rollup.global_rollup(rollup.system_summaries(parts)).first()["n_systems"] == 2
