import json
import socket
import threading
import time
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from sievelog.__main__ import main
from sievelog.config import Settings
from sievelog.operators.store import Conflict, Store
from sievelog.plans.query import matches, parse_query
from sievelog.service import Service, serve
from sievelog.sources.sockets import LineBuffer, LineServer, LineSource
from sievelog.streaming.ingest import stream_into


def fill(spark, store, lines, **more):
    return store.ingest(spark.createDataFrame(list(enumerate(lines)), "n long, line string"), order=["n"], **more)


def make(spark, tmp_path, rows):
    return Store(spark, f"file://{tmp_path}/store", Settings(block_rows=rows))


def test_cross_block(spark, tmp_path):
    store = make(spark, tmp_path, 2)
    assert fill(spark, store, ["alpha first block", "beta first block", "gamma second block"]) == 3
    assert store.manifest.sealed_before == 1 and store.manifest.active_lines == 1
    assert store.search("beta").lines() == ["beta first block"] and store.search("gamma").lines() == ["gamma second block"]
    assert store.search("first", indexed=True).total == 2 and store.search("NOT beta", indexed=True).lines() == ["gamma second block", "alpha first block"]


def test_sealed(spark, tmp_path):
    store = make(spark, tmp_path, 8)
    fill(spark, store, ["auth_error login failed", "auth_error token expired", "user created successfully"])
    assert store.flush() and store.manifest.sealed_before == 1
    assert store.search("auth_error").total == 2 and store.search("auth_error", indexed=True).total == 2


def test_flushing_is_visible(spark, tmp_path):
    store = make(spark, tmp_path, 2)
    store.append(spark.createDataFrame([("needle one",), ("needle two",)], "line string"))
    assert {r["tier"] for r in store.blocks().collect()} == {"flushing"} and store.search("needle").total == 2
    store.seal()
    assert [(r["block_id"], r["num_lines"], r["tier"], r["idx_entries"]) for r in store.blocks().collect()] == [(0, 2, "sealed", 3)]
    assert store.search("needle").total == 2


def test_limit(spark, tmp_path):
    store = make(spark, tmp_path, 100)
    fill(spark, store, [f"error line {i}" for i in range(1, 11)])
    found = store.search("error", 3)
    assert found.total == 10 and found.lines() == ["error line 1", "error line 2", "error line 3"]
    none = store.search("error", 0)
    assert none.total == 10 and none.lines() == []


def test_key_value_and_boolean(spark, tmp_path):
    store = make(spark, tmp_path, 100)
    fill(spark, store, ["env=prod region=us-east-1", "auth error login failed", "auth success login ok", "db error connection timeout", "user created successfully"])
    total = lambda q: store.search(q).total
    assert total("prod") == total("env") == 1
    assert total("auth AND error") == 1 and total("error OR success") == 3
    assert store.search("auth AND NOT error").lines() == ["auth success login ok"] and total("NOT auth") == 3


def test_boolean_cross_block(spark, tmp_path):
    store = make(spark, tmp_path, 2)
    fill(spark, store, ["alpha needle", "beta needle", "gamma needle"])
    assert store.search("alpha AND needle").lines() == ["alpha needle"]


def test_restart(spark, tmp_path):
    store = make(spark, tmp_path, 1000)
    fill(spark, store, ["persist me alpha", "persist me beta"])
    assert make(spark, tmp_path, 1000).search("persist").total == 2  # lines are on disk before they are sealed
    store.flush()
    again = make(spark, tmp_path, 1000)
    assert again.search("persist").total == 2 and again.manifest.active_block == 1
    fill(spark, again, ["later"])
    assert sorted(r["block_id"] for r in again.lines().collect()) == [0, 0, 1]


def test_empty_flush(spark, tmp_path):
    store = make(spark, tmp_path, 10)
    assert not store.flush() and make(spark, tmp_path, 10).block_ids().count() == 0
    assert fill(spark, store, []) == 0 and store.search("x").total == 0 and store.search("NOT x", indexed=True).total == 0


def test_many_blocks_and_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", Settings(block_rows=50, pack_rows=20))
    for k in range(3):
        fill(spark, store, [f"line {k} {i} {'even' if i % 2 == 0 else 'odd'}" for i in range(70)])
    assert store.manifest.active_block == 4 and store.manifest.active_lines == 10
    places = [(r["block_id"], r["line_id"]) for r in store.lines().orderBy("block_id", "line_id").collect()]
    assert places == [(i // 50, i % 50) for i in range(210)]
    before = sorted(store.search("odd AND NOT 2", indexed=True).lines())
    assert store.compact() == 0 and store.compact(full=True) == 3 and store.compact(full=True) == 0 and store.vacuum() > 0
    assert sorted(store.search("odd AND NOT 2", indexed=True).lines()) == before and make(spark, tmp_path, 50).search("odd").total == 105


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indexed_search_shuffles_no_postings_and_prunes(spark, tmp_path):
    """Lists are met inside their buckets, by the terms asked for; lines of the first matches by their packs, and few rows read."""
    store = Store(spark, f"file://{tmp_path}/store", Settings(block_rows=4000, pack_rows=100))
    lines = spark.range(20_000).select("id", F.concat(F.lit("common w"), F.col("id") % 50, F.when(F.col("id") == 12_345, " rare").otherwise("")).alias("line"))
    stored = store.ingest(lines, order=["id"])
    assert stored == 20_000 and list(stored.flushed_blocks) == [0, 1, 2, 3, 4]
    found = store.search("common AND w7 AND NOT rare", 10)
    shown = plan(found.found)
    assert "Exchange" not in shown and "In(term, [,common,rare,w7])" in shown and "Bucketed: true" in shown
    assert found.total == 400 and found.lines()[:2] == ["common w7", "common w7"]
    rare = store.search("rare", 10)
    rows = rare.rows
    assert "PushedFilters: [IsNotNull(block_id)" in plan(rows) or "EqualTo(block_id,3)" in plan(rows)
    assert [r["line_id"] for r in rows.collect()] == [345] and rare.total == 1
    scanned = [r for r in store.search("rare OR w7", 3).rows.select("block_id", "line_id").collect()]
    assert [(r["block_id"], r["line_id"]) for r in scanned] == [(0, 7), (0, 57), (0, 107)]
    again = Store(spark.newSession(), store.root, store.settings)
    assert again.search("NOT common").total == 0 and again.search("NOT rare").total == 19_999 and "Exchange" not in plan(again.search("rare").found)


def test_any_query_depth(spark, tmp_path):
    store = make(spark, tmp_path, 3)
    fill(spark, store, ["a", "b", "a b", "c", "a c"])
    q = "a"
    for i in range(300):
        q = f"({q} OR zz) AND NOT (zz{i} AND c)" if i % 2 else f"NOT ({q} AND c)"
    model = sorted(x for x in ["a", "b", "a b", "c", "a c"] if matches(parse_query(q), set(x.split())))
    for indexed in (True, False):
        assert sorted(store.search(q, indexed=indexed).lines()) == model
    assert store.search("NOT " * 10_000 + "a").total == 3 and store.search("(" * 5_000 + "a" + ")" * 5_000).total == 3


def test_compaction_by_tiers(spark, tmp_path):
    """Only runs of segments of one size are merged, and every line is still found once."""
    store = make(spark, tmp_path, 2)
    fill(spark, store, [f"big {i}" for i in range(64)])
    for k in range(3):
        fill(spark, store, [f"small {k}", "small x"])
    assert [s.lines for s in store.manifest.sealed] == [64, 2, 2, 2] and store.compact() == 0 and store.compact(fan_in=3) == 3
    assert [s.lines for s in store.manifest.sealed] == [64, 6] and store.search("small").total == 6 and store.search("NOT small").total == 64
    assert sorted(store.search("x").lines()) == ["small x"] * 3 and store.blocks().agg(F.sum("num_lines")).head()[0] == 70


def test_batches_count_once(spark, tmp_path):
    store = make(spark, tmp_path, 10)
    assert fill(spark, store, ["a"], source="s", batch_id=0) == 1 and fill(spark, store, ["a"], source="s", batch_id=0) == 0
    assert fill(spark, store, ["b"], source="s", batch_id=1) == 1 and store.search("a OR b").total == 2


def test_conflict(spark, tmp_path):
    one, two = make(spark, tmp_path, 10), make(spark, tmp_path, 10)
    fill(spark, one, ["a"])
    with pytest.raises(Conflict):
        fill(spark, two, ["b"])
    two.refresh()
    fill(spark, two, ["b"])
    assert make(spark, tmp_path, 10).search("a OR b").total == 2


def test_nulls_and_normalized_empty_lines(spark, tmp_path):
    store = make(spark, tmp_path, 10)
    assert store.ingest(spark.createDataFrame([(None,), ('""',), ("x",)], "line string")) == 2
    assert sorted(store.search("NOT y").lines()) == ["", "x"] and store.search("").total == 0


def test_settings():
    s = Settings.from_env({"SIEVELOG_BLOCK_ROWS": "0", "SIEVELOG_SEARCH_LIMIT": "7", "SIEVELOG_PACK_ROWS": "x"})
    assert (s.block_rows, s.pack_rows) == (1, 1024)
    assert s.resolve_limit(None) == 7 and s.resolve_limit(0) is None and s.resolve_limit(5) == 5
    assert Settings.from_env({"SIEVELOG_SEARCH_LIMIT": "0"}).resolve_limit(None) == 0
    with pytest.raises(ValueError):
        Settings(pack_rows=0)


def test_line_buffer():
    buffer = LineBuffer()
    assert buffer.feed(b"one\r\ntw") == ["one"] and buffer.feed(b"") == [] and buffer.feed("o é".encode()[:-1]) == []
    assert buffer.feed("é".encode()[1:] + b"\n\n\xff\n") == ["two é", "�"] and buffer.feed(b"rest") == [] and buffer.end() == ["rest"]


def wait(check, seconds=20):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if check():
            return True
        time.sleep(0.05)
    return check()


@pytest.mark.parametrize("kind", ["tcp", "udp"])
def test_sockets(spark, tmp_path, kind):
    store = make(spark, tmp_path, 100)
    server = LineServer(lambda lines: fill(spark, store, lines), kind)
    if kind == "tcp":
        with socket.create_connection(("127.0.0.1", server.port)) as s:
            s.sendall(b"net_alpha line\nnet_beta line\n")
            assert wait(lambda: store.search("line").total == 2)  # flushed while the connection is open
            s.sendall(b"net_gamma")
    else:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.sendto(b"net_alpha line\nnet_beta line\r\n\n", ("127.0.0.1", server.port))
            s.sendto(b"net_gamma", ("127.0.0.1", server.port))
    assert wait(lambda: store.search("net_gamma").total == 1)
    server.stop()
    assert store.search("net_alpha").total == 1 and store.search("line").total == 2


def test_tcp_batches():
    got = []
    server = LineServer(got.append, batch=3, flush_ms=100)
    with socket.create_connection(("127.0.0.1", server.port)) as s:
        s.sendall(b"".join(b"%d\n" % i for i in range(8)))
    assert wait(lambda: sum(map(len, got)) == 8)
    server.stop()
    assert [len(x) for x in got][:2] == [3, 3] and [y for x in got for y in x] == [str(i) for i in range(8)]


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"message":"from stream"}\nplain stream\n')
    store = make(spark, tmp_path, 2)
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    stream_into(store, lines, str(tmp_path / "check"), once=True).awaitTermination(60)
    stream_into(store, lines, str(tmp_path / "check"), once=True).awaitTermination(60)
    assert sorted(store.search("stream").lines()) == ["from stream", "plain stream"]


def test_socket_stream(spark, tmp_path):
    spark.dataSource.register(LineSource)
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    store = make(spark, tmp_path, 100)
    query = stream_into(store, spark.readStream.format("sievelog_lines").option("kind", "tcp").option("port", port).load(), str(tmp_path / "check"))
    try:

        def send():
            try:
                with socket.create_connection(("127.0.0.1", port), 1) as s:
                    s.sendall(b"streamed one\nstreamed two\n")
                return True
            except OSError:
                return False

        assert wait(send, 40) and wait(lambda: store.search("streamed").total == 2, 40)
    finally:
        query.stop()


def test_process(spark, tmp_path, capsys):
    """All ports of a running service, and what is left after it stops."""
    stop, root = threading.Event(), f"file://{tmp_path}/store"
    run = threading.Thread(target=main, args=(["--root", root, "--http", "0", "--tcp", "0", "--udp", "0"], stop))
    run.start()
    said = []
    assert wait(lambda: said.append(capsys.readouterr().out) or "udp" in "".join(said), 30)
    http, tcp, udp = (int(x.split()[1]) for x in "".join(said).strip().split(", "))
    with socket.create_connection(("127.0.0.1", tcp)) as s:
        s.sendall(b'{"message":"tcp_line"}\n')
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"udp_line", ("127.0.0.1", udp))

    def both():
        with urllib.request.urlopen(f"http://127.0.0.1:{http}/search?query=tcp_line+OR+udp_line") as r:
            return json.loads(r.read())["total"] == 2

    assert wait(both, 30)
    stop.set()
    run.join(60)
    left = Store(spark, root)
    assert left.manifest.active_lines == 0 and sorted(left.search("tcp_line OR udp_line", indexed=True).lines()) == ["tcp_line", "udp_line"]


def test_http(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", Settings(block_rows=3, search_limit=2))
    service = Service(spark, store)
    server = serve(service, port=0, most=1000)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(base + path, None if body is None else json.dumps(body).encode()) as r:
                text = r.read()
                return r.status, json.loads(text) if path != "/" else text
        except urllib.error.HTTPError as e:
            return e.code, None

    find = lambda **q: call("/search?" + urllib.parse.urlencode(q))
    assert call("/ingest", ["auth error", '{"msg":"auth ok"}', "", "db\nerror"]) == (200, {"ingested": 4})
    assert find(query="auth AND error") == (200, {"query": "auth AND error", "count": 1, "total": 1, "results": ["auth error"]})
    assert find(query="NOT nothing")[1]["count"] == 2 and find(query="NOT nothing", limit=0)[1]["count"] == 4
    assert find(query="(a")[0] == 400 and find(query="a", limit="x")[0] == 400 and call("/search?limit=1")[0] == 400
    assert call("/search", {"query": {"and": [{"term": "auth"}, {"not": {"term": "error"}}]}}) == (200, {"query": "auth AND (NOT error)", "count": 1, "total": 1, "results": ["auth ok"]})
    assert call("/search", {"query": {"no": 1}})[0] == 400 and call("/ingest", {"no": 1})[0] == 400 and call("/none")[0] == 404
    assert call("/")[0] == 200 and call("/ingest", []) == (200, {"ingested": 0})
    assert find(query="error OR ok", limit=0)[1]["total"] == 3
    service.full.wait(0)
    assert wait(lambda: store.manifest.sealed_before == 1) and find(query="auth")[1]["results"] == ["auth error", "auth ok"]
    with socket.create_connection(server.server_address) as s:  # refused before it is read
        s.sendall(b"POST /ingest HTTP/1.0\r\nContent-Length: 2000\r\n\r\n")
        assert b" 413 " in s.recv(100)
    server.shutdown()
