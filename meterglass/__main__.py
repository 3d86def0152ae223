"""Command line: graph, tail-sim, tail-live and profile over one home folder's logs.

    python -m meterglass graph --home ~ [--year 2026] [--clients claude,codex] [--root grok=DIR] [--facts DIR]
    python -m meterglass tail-sim --home ~ | --root DIR --client claude --now-ms N [--window 600]
    python -m meterglass tail-live --home ~ | --root DIR --client claude [--ticks 12] [--emit-s 180]
    python -m meterglass profile --home ~ [--facts DIR]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from .functions.time import rfc3339_text
from .operators import messages, rollup, trace
from .session import fresh_path, session
from .sources import logs
from .sources.files import Config
from .streaming import live

#: Seconds between live ticks and between full refreshes.
TICK_S, REFRESH_S = 5, 1800
#: Bytes of growth that a live batch takes of a folder.
BATCH_BYTES = 1 << 28


def clock() -> int:
    return int(time.time() * 1000)


def config_of(home: str, now_ms: int, roots: list[str] | None = None) -> Config:
    """Where logs lie: ``client=path`` roots (several of one client are all read), then the clients' own variables, then the usual folders."""
    env, given = os.environ.get, {}
    for root in roots or []:
        client, equals, path = root.partition("=")
        if not equals or client not in (*logs.SOURCES, "codex_exports", "copilot_exporter"):
            raise ValueError(f"not client=path: {root}")
        given.setdefault(client, []).append(path)
    agent = env("PI_CODING_AGENT_DIR") or (f"{env('PI_CONFIG_DIR')}/agent" if env("PI_CONFIG_DIR") else None)
    for client, path in (("hermes", env("HERMES_HOME")), ("grok", env("GROK_HOME")), ("copilot_exporter", env("COPILOT_OTEL_FILE_EXPORTER_PATH")), ("omp", agent)):
        if path:
            given.setdefault(client, [path])
    return Config(home=home, now_ms=now_ms, data_home=env("XDG_DATA_HOME"), codex_home=env("CODEX_HOME"), roots=given)


def show_graph(spark, config: Config, facts: str, clients: list[str] | None = None, year: str | None = None) -> None:
    now = clock()
    rows = logs.ingest(spark, config, facts, clients)
    stamp = spark.range(1).select(rfc3339_text(F.lit(now))).first()[0]
    doc = rollup.payload(messages.enriched(rows, year), stamp).first()["payload"]
    print(json.dumps(json.loads(doc), sort_keys=True), flush=True)


def graph(args) -> None:
    spark = session("graph", args.time_zone)
    config = config_of(args.home, clock(), args.root)
    show_graph(spark, config, args.facts or fresh_path(spark, "facts"), args.clients.split(",") if args.clients else None, args.year)


def followed(spark, args, now_ms: int | None = None, **options):
    """The events of ``--client`` under ``--root``, or of all clients of ``--home``. ``options``: of the sources."""
    if args.client:
        if not args.root:
            raise ValueError("--client needs --root")
        return live.live_events(spark, args.client, args.root, now_ms, **options)
    config = config_of(args.home or str(Path.home()), clock())
    return live.all_events(spark, {c: logs.existing(spark, logs.READS[c].roots(spark, config)) for c in live.LIVE}, now_ms, **options)


def tail_sim(args) -> None:
    """One cold tick with a pinned clock: events and trace in a fixed order."""
    spark = session("tail-sim", args.time_zone)
    work = args.work or fresh_path(spark, "tail")
    query = live.follow(followed(spark, args, args.now_ms), f"{work}/checkpoint", args.now_ms)
    query.processAllAvailable()
    query.stop()
    rows = trace.retained(live.hour(spark, f"{work}/checkpoint"), args.now_ms)
    order = ["ts_ms", "client", "agent", "model", "input", "output", "cache_read", "cache_write"]
    found = {
        "events": [r.asDict() for r in rows.select(*order).orderBy(*order).collect()],
        "trace": [r.asDict() for r in trace.sorted_trace(trace.trace(rows, args.now_ms, args.window)).collect()],
        "tokens_per_min": trace.rate(rows, args.now_ms).first()[0],
    }
    print(json.dumps(found, sort_keys=True))


def tail_live(args) -> None:
    """A tick every ``TICK_S`` seconds: rates and trace are printed when they change, the graph of ``--home`` every ``REFRESH_S``.

    With ``--emit-s`` each client's rate is printed as well, at most that often and when it changed, also over restarts with the same ``--work``.
    """
    spark = session("tail-live", args.time_zone)
    work = args.work or fresh_path(spark, "tail")
    events = followed(spark, args, batch_bytes=BATCH_BYTES, progress=f"{work}/progress")
    send = (lambda rows: print(json.dumps({"rates": [r.asDict() for r in rows]}), flush=True)) if args.emit_s is not None else None
    query = live.follow(events, f"{work}/checkpoint", send=send, emit_ms=(args.emit_s or 0) * 1000, window_s=args.window, processingTime=f"{TICK_S} seconds")

    def view():
        now, rows = clock(), live.hour(spark, f"{work}/checkpoint")
        shown = trace.sorted_trace(trace.trace(rows, now, args.window)).select(F.to_json(F.struct("*")).alias("row"))
        per_min = [F.lit(trace.rate(rows, now, s).first()[0]).alias(f"per_min_{s}") for s in (trace.SHORT_WINDOW_S, args.window)]
        return spark.range(1).select(*per_min, F.lit([r["row"] for r in shown.collect()] or None).alias("trace"))  # a trace: a few rows

    tick = live.PublishOnChange(view, lambda rows: print(json.dumps({"tokens_per_min": rows[0][0], "in_window": rows[0][1], "trace": [json.loads(r) for r in rows[0][2] or []]}), flush=True))
    refreshed = None
    query.processAllAvailable()
    for n in range(args.ticks):
        if n:
            time.sleep(TICK_S)
        if query.exception():
            raise query.exception()
        tick()
        if args.home and (refreshed is None or time.monotonic() - refreshed >= REFRESH_S):
            refreshed = time.monotonic()
            show_graph(spark, config_of(args.home, clock()), f"{work}/facts")
    query.stop()


def profile(args) -> None:
    """Seconds from the logs to the payload: cold (all parsed, nothing kept), fill (all parsed and kept) and warm (only what changed since)."""
    spark = session("profile", args.time_zone)
    config, facts, took = config_of(args.home, clock(), args.root), args.facts or fresh_path(spark, "facts"), {}
    for run in ("cold_s", "fill_s", "warm_s"):
        began = time.time()
        rows = logs.collect(spark, config) if run == "cold_s" else logs.ingest(spark, config, facts)
        rollup.payload(messages.enriched(rows), "").first()
        took[run] = time.time() - began
    print(json.dumps({k: round(v, 3) for k, v in took.items()}))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("meterglass", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--time-zone", default="UTC")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("graph")
    g.add_argument("--home", default=str(Path.home()))
    g.add_argument("--year")
    g.add_argument("--clients")
    g.add_argument("--facts", help="folder for the fact table, shared on a cluster; a later run with the same one parses what changed")
    g.add_argument("--root", action="append", help="client=folder, in place of its usual ones; may be repeated")
    t = sub.add_parser("tail-sim")
    t.add_argument("--root")
    t.add_argument("--client", choices=live.LIVE, help="one client's logs under --root; without it all clients' of --home")
    t.add_argument("--home")
    t.add_argument("--now-ms", type=int, required=True)
    t.add_argument("--window", type=int, default=trace.LONG_WINDOW_S)
    t.add_argument("--work")
    n = sub.add_parser("tail-live")
    n.add_argument("--root")
    n.add_argument("--client", choices=live.LIVE)
    n.add_argument("--ticks", type=int, default=12)
    n.add_argument("--window", type=int, default=trace.LONG_WINDOW_S)
    n.add_argument("--home", help="print its graph as well")
    n.add_argument("--emit-s", type=int, help="seconds between the rates of a client, which are then printed")
    n.add_argument("--work")
    f = sub.add_parser("profile")
    f.add_argument("--home", default=str(Path.home()))
    f.add_argument("--facts")
    f.add_argument("--root", action="append")
    args = p.parse_args(argv)
    try:
        {"graph": graph, "tail-sim": tail_sim, "tail-live": tail_live, "profile": profile}[args.command](args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
