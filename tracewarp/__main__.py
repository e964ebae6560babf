"""python -m tracewarp: version, generate, validate, load, evaluate, query."""

from __future__ import annotations

import argparse
import json
import sys
import time

VERSION = "0.1.0"


def report(spark, root: str) -> dict:
    """Accuracy of the ranking over all incidents below a folder, as a whole, by fault and by ablation."""
    from tracewarp.operators import inference
    from tracewarp.sources import incidents

    paths = [e.path for e in incidents.discover(root)]
    feats = inference.features(incidents.load(spark, paths))
    truth = incidents.labels_table(spark, paths)
    each = inference.evaluate(inference.rank_candidates(feats), truth)
    by = inference.summarise(each.join(truth.select("incident_id", "fault_type"), "incident_id"), "fault_type")
    return {"overall": inference.summarise(each).first().asDict(), "by_fault": [r.asDict() for r in by.orderBy("fault_type").collect()], "ablations": [r.asDict() for r in inference.ablated(feats, truth).collect()]}


def markdown(r: dict) -> str:
    line = lambda name, x: f"| {name} | {x['incidents']} | {x['top1']:.3f} | {x['top3']:.3f} | {x['mrr']:.3f} |"
    rows = [line("all", r["overall"]), *(line(x["fault_type"], x) for x in r["by_fault"]), *(line(x["ablation"], x) for x in r["ablations"] if x["ablation"] != "none")]
    return "\n".join(["| incidents | n | top-1 | top-3 | MRR |", "|-|-|-|-|-|", *rows])


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tracewarp")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name, *args in (("generate", "root"), ("validate", "root"), ("load", "path"), ("evaluate", "root"), ("query", "path", "sql"), ("recovery", "path", "checkpoints")):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    sub.choices["evaluate"].add_argument("--markdown", action="store_true")
    sub.choices["query"].add_argument("--explain", action="store_true")
    a = p.parse_args(argv)
    from tracewarp.sources import fixtures, incidents

    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "generate":
        print(fixtures.write_memory_incident(f"{a.root}/fixtures/v1/rec-mem-001"), *fixtures.write_suite(a.root), sep="\n")
        return 0
    if a.command == "validate":
        bad = 0
        for e in incidents.discover(a.root):
            try:
                incidents.manifest(e.path, verify=True)
                incidents.labels(e.path)
                print("ok", e.incident_id)
            except (ValueError, OSError) as err:
                bad += 1
                print("BAD", e.incident_id, err)
        return int(bad > 0)
    from tracewarp.session import local_session

    spark = local_session()
    if a.command == "load":
        print(json.dumps({r.signal: r.n for r in incidents.envelopes(incidents.load(spark, [a.path])).groupBy("signal").count().withColumnRenamed("count", "n").collect()}))
    elif a.command == "evaluate":
        r = report(spark, a.root)
        print(markdown(r) if a.markdown else json.dumps(r))
    elif a.command == "query":
        from tracewarp.replay import Session

        s = Session(spark, a.path)
        s.clock.seek(s.clock.end_ns)
        print(s.explain(a.sql, analyze=True) if a.explain else "\n".join(json.dumps(r.asDict()) for r in s.query(a.sql).collect()))
    elif a.command == "recovery":
        from tracewarp.replay import Session

        s = Session(spark, a.path, a.checkpoints)
        s.clock.seek(s.clock.end_ns)
        t = time.monotonic()
        s.checkpoint()
        u = time.monotonic()
        print(json.dumps({"checkpoint_s": round(u - t, 3), "same_evidence": Session.recovered(spark, a.checkpoints)[1], "recovery_s": round(time.monotonic() - u, 3)}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
