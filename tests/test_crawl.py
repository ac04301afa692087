"""The crawl engine: every query against its SQL, the stateful parts against plain Python, and the archive round trip."""

import hashlib
import html
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.config import Settings, env_key, settings as read_settings
from weftline.functions import robots, scheduling, sketch, urls
from weftline.operators import frontier, ring
from weftline.plans import queries, rounds
from weftline.sources import shared, state, tables, warc, web
from weftline.streaming import crawl

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("pages", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return repr(v) if v is not None else ""


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_hosts_and_links(spark):
    rows = [("https://A.b:8080/x", "A.b"), ("mailto:a@b", ""), ("", ""), ("https://u:p@h/", "h"), ("http://[::1]:80/", "::1"), ("http://a_b.c/", "a_b.c"), (None, "")]
    got = spark.createDataFrame([(u,) for u, _ in rows], "u string").select("u", urls.host(urls.F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in got} == dict(rows)
    assert urls.robots_url(urls.F.lit("https://h:1/p?q=1#f")) is not None
    base = "https://h/a/b?q#f"
    want = {"/x": "https://h/x", "c": "https://h/a/c", "../d": "https://h/d", "//o/p": "https://o/p", "#t": "https://h/a/b?q#t", "?z": "https://h/a/b?z", "": base, "mailto:m@n": "mailto:m@n", "http://%zz": None}
    got = spark.createDataFrame([(base, h) for h in want], "b string, h string").select("h", urls.resolve(urls.F.col("b"), urls.F.col("h")).alias("u")).collect()
    assert {r.h: r.u for r in got} == want


def test_page_parser_decodes_entities():
    assert urls.parse_page("<head><title>a &amp; b</title><a href='/x?a&amp;b'>t</a>")[1:] == ("a & b", ["/x?a&b"])


#: Pages whose references are whole, cut, unknown, numeric, or none.
REFERENCES = [f"<html><head><title>{t}</title></head><body><p>{t}</p><a href=\"/x?a&amp;b=1&amp\">l</a></body></html>" for t in ("a &amp;&amp;&amp", "q &quot;0&quot", "&lt;b&gt; &lt &gt", "&amp;lt;", "&copy; &copy &nosuch; &#39; &Eacute;", "AT&T &", "\ue000 &amp; \ue001", "none")]


def equals_sql_on(spark, tmp_path, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    found = c.execute(queries.ORACLES[name])
    assert sorted(tuple(r) for r in df.select(*(d[0] for d in found.description)).collect()) == sorted(found.fetchall())


def test_parsed_pages_equal_sql_whatever_the_references(spark, tmp_path):
    equals_sql_on(spark, tmp_path, "page_parse", [*((i, "https://h/", h) for i, h in enumerate(REFERENCES)), (99, "https://h/", None)])
    for h in REFERENCES:
        assert urls.parse_written(h)[2] == urls.parse_page(h)[2]
        assert tuple(map(html.unescape, urls.parse_written(h)[:2])) == urls.parse_page(h)[:2]


def test_titles_equal_sql_whatever_the_references(spark, tmp_path):
    equals_sql_on(spark, tmp_path, "title_extract", [*((i, "https://h/", h) for i, h in enumerate(REFERENCES)), (99, "https://h/", None)])


@pytest.mark.parametrize("name", ["seeds_union_links", "link_count_by_host", "link_extract", "link_resolve", "link_scheme_filter", "soup_links", "title_extract", "page_parse"])
def test_pages_reach_python_a_hundred_at_a_time(spark, name):
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_float32_budgets(spark):
    rows = [(3000,), (None,), (0,), (5000,), (6000,)]
    df = spark.createDataFrame(rows, "t long")
    got = {r.t: (r.a, r.b, r.c) for r in df.select("t", scheduling.session_budget(df.t, 5).alias("a"), scheduling.session_budget(df.t, 20).alias("b"), scheduling.url_weight(df.t, 20).alias("c")).collect()}
    assert got[3000] == (1, 7, 12) and got[None] == (5, 20, 1) and got[0] == (5, 20, 1) and got[5000] == (0, 0, 20) and got[6000] == (0, 0, 24)


def queue(spark, rows):
    return spark.createDataFrame(rows, rounds.QUEUE)


def test_fifo(spark):
    own = queue(spark, [("myqueue1", i, str(i), 1) for i in range(10)])
    first, rest = frontier.pop(own, 1)
    assert [r.url for r in first.collect()] == ["0"] and frontier.peek(rest).first().url == "1"


def test_queues_are_isolated(spark):
    own = queue(spark, [(f"myqueue{q}", i, str(i), 1) for q in range(3, 13) for i in range(10)])
    assert frontier.length(own).filter("host = 'myqueue12'").first().n == 10
    assert frontier.pop(own, 10)[1].count() == 0


def test_session_prefix(spark):
    own = queue(spark, [("h", 0, "a", 3), ("h", 1, "b", 3), ("h", 2, "c", 1)])
    take = lambda b: [r.url for r in frontier.session_prefix(own, scheduling.F.lit(b)).orderBy("seq").collect()]
    assert take(5) == ["a", "b"] and take(0) == ["a"]


def test_nearest_priority_first(spark):
    assert frontier.next_hosts(spark.createDataFrame([("10", 1), ("12", 2)], "host string, next_at_ms long"), 1).first().host == "10"


def test_rotation(spark):
    hosts = spark.createDataFrame([("A", "inactive", True, 0), ("B", "inactive", False, 1), ("C", "inactive", False, 2), ("D", "inactive", False, 3)], "host string, status string, locked boolean, inactive_rank long")
    own = queue(spark, [(h, 0, "u", 1) for h in "ACD"])
    assert [r.host for r in frontier.available(hosts, own, 1).collect()] == ["C"]
    assert [r.host for r in frontier.rotate(hosts, own, 1).orderBy("inactive_rank").collect()] == ["D", "A", "B"]


@settings(max_examples=50, deadline=None)
@given(st.text("ab", max_size=3), st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=4, unique=True))
def test_ring_owner_is_total(key, members):
    ids = sorted((ring.key_of(f"{m}:{i}"), m) for m in members for i in range(3))
    k = hashlib.sha1(key.encode()).hexdigest()
    assert next((m for v, m in ids if v >= k), ids[0][1]) in members


def test_between(spark):
    rows = [(5, 1, 9, True), (1, 1, 9, False), (9, 1, 9, False), (0, 9, 1, True), (5, 9, 1, False), (9, 9, 1, False), (3, 3, 3, False), (4, 3, 3, True)]
    df = spark.createDataFrame(rows, "k int, a int, b int, want boolean")
    assert df.filter(ring.between(df.k, df.a, df.b) != df.want).count() == 0


def test_ring_against_plain_search(spark):
    made = ring.build(tables.members(spark, tables.JOINED))
    ids = sorted((r.vnode_id, r.addr) for r in made.collect())
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(500)] + [ids[0][0], ids[-1][0], "0" * 40, "f" * 40, None]
    got = {r.key: (r.vnode_id, r.owner) for r in ring.owner(spark.createDataFrame([(k,) for k in keys], "key string"), made).collect()}
    assert got == {k: (None, None) if k is None else next((x for x in ids if x[0] >= k), ids[0]) for k in keys}
    assert ring.owner(spark.createDataFrame([("0",)], "key string"), made.limit(0)).first().owner is None
    assert ring.finger_id("0" * 40, 0) == ring.finger_id("0" * 40, 1) == "0" * 39 + "1"
    assert ring.neighbours(made, 3).columns == ["vnode_id", "succ1", "succ2", "succ3", "pred"]


def test_moved_hosts_are_looked_up_once_each(spark):
    keys = tables.crawl_log(spark, SF).select("host").distinct()
    plan = ring.moved(keys, ring.build(tables.members(spark)), ring.build(tables.members(spark, tables.JOINED)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate")


def test_robots_longest_match():
    rules = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.gif$\n\nUser-agent: x\nUser-agent: y\nDisallow: /")
    ok = lambda agent, path: robots.allowed(rules, agent, path)
    assert [ok("GoBot/1.0", p) for p in ("/", "/a", "/a/b", "/i.gif", "/i.gif?")] == [True, False, True, False, True]
    assert not ok("y", "/") and robots.allowed([], "y", "/")


def test_capture_carries_id_and_date(spark):
    at = scheduling.F.lit("2020-02-02 02:02:02").cast("timestamp")
    base = warc.resource(spark.createDataFrame([("qwerty", "")], "url string, html string"), at, "text/plain")
    other = warc.metadata(spark.createDataFrame([("qwerty", 1), ("qwerty", 2)], "url string, ttr_ms long"), scheduling.F.current_timestamp())
    id_ = base.first().record_id
    assert [(r.date, r.headers["warc-concurrent-to"]) for r in warc.capture(base, other).collect()] == [("2020-02-02T02:02:02Z", id_)] * 2


def test_archive_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html")
    records = warc.resource(pages, scheduling.F.lit("2020-02-02 02:02:02").cast("timestamp"))
    files = warc.write(records, f"{tmp_path}/out", most=50_000).collect()
    assert sum(f.records for f in files) == records.count() and len(files) == len(os.listdir(f"{tmp_path}/out")) > 1
    back = warc.read(spark, f"{tmp_path}/out/*.gz")
    assert back.filter("type = 'warcinfo'").count() == len(files)
    shape = lambda df: sorted((r.record_id, r.date, tuple(sorted(r.headers.items())), bytes(r.content)) for r in df.collect())
    assert shape(back.filter("type = 'resource'")) == shape(records)


def simulate(pages, seeds, conf, n):
    """What the rounds fetch, host by host, in plain Python."""
    queues, seen, ttr, ready, fetched = {}, set(), {}, [], []
    host = lambda u: u.split("/")[2]
    for u in seeds:
        queues.setdefault(host(u), []).append((u, 1))
        if host(u) not in ready:
            ready.append(host(u))
    budget = dict.fromkeys(queues, conf.session_budget)
    for _ in range(n):
        known, old, found = dict(ttr), set(seen), []
        for h in sorted(queues):
            spent, own, took = 0, queues[h], set()
            if not own:
                continue
            while own and (spent < budget[h] or not spent):
                u, w = own.pop(0)
                spent += w
                if u in old or u in took:
                    continue
                took.add(u)
                fetched.append(u)
                seen.add(u)
                if u in pages:
                    ttr[h] = pages[u][0]
                    found += pages[u][1]
            budget[h] = max(0, budget[h] - spent)
            if budget[h] <= 0 or not own:
                budget[h] = None
        for u in found:
            if u not in old:
                w = max(1, int(known[host(u)] / 5000 * conf.session_budget)) if host(u) in known else 1
                if host(u) not in queues:
                    budget[host(u)] = conf.session_budget
                queues.setdefault(host(u), []).append((u, w))
        for h, b in budget.items():
            if b is None:
                budget[h] = max(0, int((1 - ttr[h] / 5000) * conf.session_budget)) if h in ttr else conf.session_budget
    return fetched


def test_rounds_against_a_simulation(spark, tmp_path):
    conf = rounds.Conf(max_active=100, session_budget=3)
    site = {f"https://h{h}/p{p}": (1000 * h, sorted({f"https://h{(h * 3 + p) % 4}/p{(p + 1) % 5}", f"https://h{h}/p{(p * 2) % 5}"})) for h in range(4) for p in range(5) if (h, p) != (2, 2)}
    seeds = ["https://h0/p0", "https://h1/p3"]
    web = spark.createDataFrame([(u, t, links) for u, (t, links) in site.items()], "url string, ttr_ms long, links array<string>")

    def fetch(rows):
        return rows.join(web, "url", "left").select("host", "seq", "url", scheduling.F.col("links").isNotNull().alias("ok"), "ttr_ms", "links")

    state = rounds.put(rounds.start(spark), spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, ord long"), conf)
    got = []
    for v in range(4):
        state, out = rounds.crawl_round(state, fetch, conf)
        got.append(sorted(r.url for r in out.collect()))
        state = state.save(str(tmp_path), v)
    flat = [u for r in got for u in r]
    assert len(flat) == len(set(flat))
    assert sorted(flat) == sorted(simulate(site, seeds, conf, 4))
    assert {r.url for r in state.seen.collect()} == set(flat)


def test_stream_equals_batch(spark, tmp_path):
    stream = crawl.crawl_stream(spark, SF)
    got = crawl.run_once(crawl.windows(stream, "1 day", "0 seconds"), "days", "append", f"{tmp_path}/a")
    batch = {(r.start, r.n, r.good) for r in crawl.windows(tables.crawl_log(spark, SF), "1 day").collect()}
    rows = {tuple(r) for r in got.collect()}
    assert rows <= batch and len(batch) - len(rows) <= 1
    state = crawl.run_once(crawl.host_state(crawl.crawl_stream(spark, SF)), "hosts", "update", f"{tmp_path}/b")
    last = {r.host: r.ttr_ms for r in frontier.last_ttr(tables.crawl_log(spark, SF)).collect()}
    assert {r.host: r.ttr_ms for r in state.collect() if r.good} == last


def test_seeds_stop_at_the_first_bad_line(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("https://a/\nhttps://b/\nhttp://%zz\nhttps://c/\n")
    assert [r.url for r in tables.seeds(spark, str(tmp_path / "seeds.txt")).orderBy("line_no").collect()] == ["https://a/", "https://b/"]


def test_settings():
    assert env_key("FRONTIER_MAX__ACTIVE") == "frontier.max_active"
    got = read_settings("frontier.max_active: 7\nring.vnodes: x\nfrontier.politeness: 3", {"WEFTLINE_FRONTIER_POLITENESS": "4"}, {"frontier.session_budget": 9, "ring.successors": -1})
    assert got == Settings(frontier_max_active=7, frontier_politeness=4, frontier_session_budget=9)


def test_settings_nest_and_reach_what_they_set(spark):
    own = read_settings("# c\ndistributed:\n  vnode_num: 3\n  batch_period: 500 # ms\n  addr: \"\"\nfrontier:\n  max_active: 7\n  seed: s.txt\nfetcher:\n  timeout: '250'\n", {"WEFTLINE_DISTRIBUTED_SUCCLIST__LENGTH": "1"})
    assert own == Settings(ring_vnodes=3, batch_period_ms=500, frontier_max_active=7, fetcher_timeout_ms=250, ring_successors=1)
    assert own.rounds() == rounds.Conf(max_active=7)
    made = own.ring(tables.members(spark))
    assert made.count() == 9 and own.neighbours(made).columns == ["vnode_id", "succ1", "pred"]


def test_sessions_follow_the_budget(spark):
    own = queue(spark, [("h", i, "u", w) for i, w in enumerate([3, 3, 1, 9, 1])] + [("g", 0, "u", 9), ("g", 1, "u", 1)])
    got = {(r.host, r.seq): r.session for r in frontier.sessions(own, 5).collect()}
    assert got == {("h", 0): 0, ("h", 1): 0, ("h", 2): 1, ("h", 3): 1, ("h", 4): 2, ("g", 0): 0, ("g", 1): 1}
    assert [r.session for r in frontier.sessions(own.filter("host = 'h'"), 0).orderBy("seq").collect()] == [0, 1, 2, 3, 4]


def test_filters_in_parts(spark):
    seen = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') as host", "concat('u', id) as url")
    asked = spark.range(2000, 8000).selectExpr("if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c')) as host", "concat('u', id) as url", "id as seq")
    known = {(r.host, r.url) for r in seen.collect()}
    for most in (100, 10**6):
        blooms = sketch.build(seen, most=most)
        rows = sketch.probe(asked, blooms).collect()
        assert len(rows) == 6000 and all(r.maybe for r in rows if (r.host, r.url) in known)
        assert not any(r.maybe for r in rows if r.host == "c")
        assert sum(r.maybe for r in rows if (r.host, r.url) not in known) < 0.03 * 6000
        both = sketch.union(blooms.filter("host = 'a'"), blooms.filter("host = 'b'"))
        assert both.count() == blooms.count()


def serve(pages):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"]))
            body = pages.get(self.path)
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write((body if body is not None else "gone").encode())

        def log_message(self, *_):
            pass

    asked = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}", asked


def test_crawl_of_a_served_site(spark, tmp_path):
    pages = {"/robots.txt": "User-agent: *\nDisallow: /no", "/": "<a href='/a'>a</a><a href=/no/x>n</a><a href='http://127.0.0.1:9/'>dead</a>", "/a": "<a href='/'>home</a><a href='/b'>b</a>", "/b": "<p>end</p>"}
    server, root, asked = serve(pages)
    own = Settings(frontier_session_budget=2, fetcher_timeout_ms=2000, fetcher_user_agent="tester/1")
    start = rounds.put(rounds.start(spark), spark.createDataFrame([(f"{root}/", 0)], "url string, ord long"), own.rounds())
    state, number = rounds.crawl(start, own.fetcher(keep=shared.cut), own.rounds(), str(tmp_path), 9)
    server.shutdown()
    out = {r.url: r for r in spark.read.parquet(f"{tmp_path}/outcomes").collect()}
    assert number < 9 and {u for u, r in out.items() if r.ok} == {f"{root}/", f"{root}/a", f"{root}/b"}
    assert out[f"{root}/no/x"].error == web.FORBIDDEN and "refused" in out["http://127.0.0.1:9/"].error
    assert all(r.ttr_ms is not None and r.body and r.error is None for r in out.values() if r.ok)
    assert [p for p, _ in asked if p == "/a"] == ["/a"] and not [p for p, _ in asked if p.startswith("/no")] and {a for _, a in asked} == {"tester/1"}
    assert {r.url for r in state.seen.collect()} == set(out)
    again, same = rounds.crawl(rounds.State.load(spark, str(tmp_path), number - 1), own.fetcher(), own.rounds(), str(tmp_path), 3, number)
    assert same == number and again.queue.count() == 0


def test_hosts_change_hands(spark):
    own = queue(spark, [("a", 0, "u1", 1), ("a", 1, "u2", 1), ("b", 0, "v", 1)])
    seen = spark.createDataFrame([("a", "u0"), ("b", "w")], rounds.SEEN)
    hosts = spark.createDataFrame([(h, "ready", None, 0, 5, False, None) for h in "ab"], rounds.HOSTS)
    gone = spark.createDataFrame([("a", "x", "y")], "host string, old_owner string, new_owner string")
    locked = rounds.lock(rounds.State(own, seen, hosts), gone)
    assert {r.host: r.locked for r in locked.hosts.collect()} == {"a": True, "b": False}
    assert {r.url for r in rounds.schedule(locked)[1].collect()} == {"v"}
    kept, given = rounds.hand_over(locked, gone)
    assert [r.host for r in kept.hosts.collect()] == ["b"] and kept.queue.count() == kept.seen.count() == 1
    other = rounds.State(queue(spark, [("a", 7, "u9", 1)]), spark.createDataFrame([("a", "u2")], rounds.SEEN), spark.createDataFrame([], rounds.HOSTS))
    new = rounds.take_over(other, given)
    assert [(r.seq, r.url) for r in new.queue.orderBy("seq").collect()] == [(7, "u9"), (8, "u1")]
    assert {r.url for r in new.seen.collect()} == {"u0", "u2"} and [(r.host, r.locked) for r in new.hosts.collect()] == [("a", False)]


def test_waits_are_capped(spark):
    hosts = spark.createDataFrame([("h", "ready", None, 0, 5, False, None)], rounds.HOSTS)
    out = spark.createDataFrame([("h", i, f"u{i}", True, 3000) for i in range(3)], "host string, seq long, url string, ok boolean, ttr_ms long")
    rows = rounds.timed(out, hosts, rounds.Conf(politeness=5)).orderBy("seq").collect()
    assert [(r.at_ms, r.done_ms, r.next_ms) for r in rows] == [(0, 3000, 18000), (13000, 16000, 31000), (26000, 29000, 44000)]


def test_upsert_keeps_one_row_a_key(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    new = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("c", 7, 1)], "key string, value int, n int")
    assert sorted(tuple(r) for r in state.upsert(store, new, order="n").collect()) == [("a", 4), ("b", 2), ("c", 7)]
    assert sorted(tuple(r) for r in state.upsert(store, new.drop("n")).collect()) == [("a", 5), ("b", 2), ("c", 7)]


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drive(spark, tmp_path, first, react, **how):
    """Feeds events a micro-batch at a time: what react makes of the actions is the next batch."""
    from weftline.streaming import frontier as live

    folder, log, batch, number = tmp_path / "in", [], first, 0
    folder.mkdir()
    while batch and number < 40:
        spark.createDataFrame(batch, live.EVENTS).coalesce(1).write.parquet(f"{folder}/b{number}")
        stream = spark.readStream.schema(live.EVENTS).option("recursiveFileLookup", True).parquet(str(folder))
        found = []
        q = live.actions(stream, **how).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = list(found)
        log += rows
        batch, number = react(rows), number + 1
    return log


def test_stream_of_a_frontier(rocks, tmp_path):
    """Sessions by budget and weight, the seen set, politeness, idle and empty hosts, in the order of one host."""
    site = {"u0": (1000, ["u1", "u2", "u1", "u0"]), "u1": (3000, ["u3"]), "u2": (None, []), "u3": (1000, ["u0"])}
    clock = [0]

    def react(rows):
        out = []
        for r in rows:
            clock[0] += 10_000
            if r.kind == "fetch":
                ttr, links = site[r.url]
                found = [("h", clock[0] + i, "found", u, None, None, None) for i, u in enumerate(links)]  # links come before the outcome
                out += [*found, ("h", clock[0] + 99, "done", r.url, ttr is not None, ttr, r.at_ms + (ttr or 0))]
            elif r.kind == "idle":
                out.append(("h", clock[0], "wake", None, None, None, None))
        return out

    log = drive(rocks, tmp_path, [("h", 0, "found", "u0", None, None, None)], react, session_budget=2, politeness=5)
    # u1 and u0 were found again before they were processed, so each spends a session of budget 0
    idle = ("idle", None)
    assert [(r.kind, r.url) for r in log] == [("fetch", "u0"), ("fetch", "u1"), idle, ("fetch", "u2"), idle, idle, idle, ("fetch", "u3"), ("empty", None)]
    assert [r.at_ms for r in log if r.kind == "fetch"][:2] == [0, 1000 + 5000]


def test_a_locked_host_waits(rocks, tmp_path):
    steps = iter([[("h", 1, "found", "b", None, None, None), ("h", 2, "done", "a", True, 10, 10)], [("h", 3, "unlock", None, None, None, None)], []])
    log = drive(rocks, tmp_path, [("h", 0, "found", "a", None, None, None), ("h", 0, "lock", None, None, None, None)], lambda rows: next(steps))
    assert [(r.kind, r.url) for r in log] == [("fetch", "a"), ("fetch", "b")] and log[1].n == 3


def test_a_lost_fetch_times_out(rocks, tmp_path):
    import time

    from weftline.streaming import frontier as live

    (tmp_path / "in").mkdir()
    feed = lambda k, *rows: rocks.createDataFrame(rows, live.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    feed(0, ("h", 0, "found", "a", None, None, None))
    stream, found = rocks.readStream.schema(live.EVENTS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), []
    q = live.actions(stream, idle_ms=50).writeStream.foreachBatch(lambda df, _: found.extend((r.kind, r.url) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()

    def wait(n):
        for _ in range(400):
            if len(found) >= n:
                return
            time.sleep(0.1)

    try:
        wait(2)
        feed(1, ("h", 1, "found", "b", None, None, None))
        wait(3)
    finally:
        q.stop()
    assert found[:3] == [("fetch", "a"), ("lost", None), ("fetch", "b")]


def test_flushed_batches_replace_themselves(spark, tmp_path):
    out = f"{tmp_path}/out"
    for _ in range(2):  # the second run has lost its checkpoint, and repeats the batch
        q = crawl.flush_batches(crawl.crawl_stream(spark, SF), out, f"{tmp_path}/cp{_}", every="1 second").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(out).count() == tables.crawl_log(spark, SF).count()


def test_first_seen_in_a_stream(spark, tmp_path):
    rows = crawl.run_once(crawl.first_seen(crawl.crawl_stream(spark, SF), "400 days"), "firsts", "append", f"{tmp_path}/c")
    log = tables.crawl_log(spark, SF)
    assert rows.count() == log.select("host", "url").distinct().count()


def test_counters_are_observed(spark):
    from weftline.streaming import metrics

    log, seen = metrics.observed(tables.crawl_log(spark, SF))
    log.write.format("noop").mode("overwrite").save()
    want = tables.crawl_log(spark, SF).selectExpr("count(*) as p", "count_if(ok) as g").first()
    assert (seen.get["processed"], seen.get["good"]) == (want.p, want.g)


def test_stream_counters(spark, tmp_path):
    from weftline.streaming import metrics

    sink = metrics.Counters()
    spark.streams.addListener(sink)
    try:
        q = metrics.observe_stream(crawl.crawl_stream(spark, SF)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/m").trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(100):
            if sink.total["processed"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(sink)
    assert sink.total["processed"] == tables.crawl_log(spark, SF).count()
    assert f"crawler_processed_total {sink.total['processed']}\n" in sink.exposition()
