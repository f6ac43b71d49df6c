"""Run a store as a service: `python -m sievelog --root file:///data/logs [--http 8080] [--tcp 8081] [--udp 8082]`.

The root, the host and the ports may also come from the environment: SIEVELOG_ROOT, SIEVELOG_HOST, SIEVELOG_HTTP,
SIEVELOG_TCP, SIEVELOG_UDP; arguments go before them.

All ports are bound before the store opens. On SIGINT or SIGTERM listeners stop, what they hold is stored, and the open
block is sealed. On a cluster, start it with spark-submit and a root that all executors reach.
"""

from __future__ import annotations

import argparse
import os
import signal
import threading

from pyspark.sql import SparkSession

from .config import Settings
from .operators.store import Store
from .service import Service, serve
from .sources.sockets import LineServer


def main(args: list[str] | None = None, stop: threading.Event | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sievelog", description="A log store with full-text search.")
    env = os.environ
    parser.add_argument("--root", default=env.get("SIEVELOG_ROOT"), required="SIEVELOG_ROOT" not in env)
    parser.add_argument("--host", default=env.get("SIEVELOG_HOST", "127.0.0.1"))
    for kind, port in (("http", 8080), ("tcp", 8081), ("udp", 8082)):
        parser.add_argument(f"--{kind}", type=int, default=env.get(f"SIEVELOG_{kind.upper()}", port))
    given = parser.parse_args(args)
    stop = stop or threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())

    settings, ready, service = Settings.from_env(), threading.Event(), None

    def take(lines: list[str]) -> None:
        ready.wait()
        service.ingest(lines)

    listeners = [LineServer(take, kind, given.host, port, settings.tcp_batch_lines, settings.tcp_flush_ms) for kind, port in (("tcp", given.tcp), ("udp", given.udp))]
    web = None
    try:
        spark = SparkSession.builder.appName("sievelog").getOrCreate()
        service = Service(spark, Store(spark, given.root, settings))
        ready.set()
        web = serve(service, given.host, given.http)
        threading.Thread(target=web.serve_forever, daemon=True).start()
        print(f"http {web.server_address[1]}, tcp {listeners[0].port}, udp {listeners[1].port}", flush=True)
        stop.wait()
    finally:
        if web is not None:
            web.shutdown()
        ready.set()
        for listener in listeners:
            listener.stop()
        if service is not None:
            service.store.flush()


if __name__ == "__main__":
    main()
