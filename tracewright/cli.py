"""Command line: ``python -m tracewright.cli <verb>``. Exit codes carry verdicts."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .functions.text import shingles, tokens
from .operators import judge, overlap, provenance, steps, worlds
from .session import local_session, ship
from .sources import readers, traces, writers


def _session():
    spark = local_session()
    ship(spark)
    return spark


def _import(args) -> int:
    found = traces.traces(readers.numbered_lines(_session(), args.path), args.format)
    if args.redact:
        found = steps.redacted(found)
    writers.save(found, args.out, "jsonl")
    return 0


def _eval(args) -> int:
    scores = judge.judged(readers.trajectories_jsonl(_session(), args.path))
    if args.out:
        scores.write.json(args.out)
    scores.agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.round(F.avg("overall"), 4).alias("mean")).show()
    return 0


def _export(args) -> int:
    writers.save(readers.trajectories_jsonl(_session(), args.path), args.out, args.format)
    return 0


def _diff(args) -> int:
    """1 when something regressed."""
    runs = [{r["id"]: bool(r["passed"]) for r in readers.manifest(Path(p).read_text())["results"]} for p in (args.before, args.after)]
    regressed = sorted(k for k, ok in runs[0].items() if ok and runs[1].get(k) is False)
    fixed = sorted(k for k, ok in runs[0].items() if not ok and runs[1].get(k))
    print(json.dumps({"regressed": regressed, "fixed": fixed, "added": sorted(runs[1].keys() - runs[0].keys()), "removed": sorted(runs[0].keys() - runs[1].keys())}))
    return int(bool(regressed) and not args.ok)


def _contamination(args) -> int:
    """1 when a scenario's task overlaps the corpus."""
    spark = _session()
    pack = readers.scenarios(Path(args.pack).read_text())
    rows = spark.createDataFrame([(k, s["task"]) for k, s in enumerate(pack)], "ord long, text string")
    corpus = readers.corpus(spark, args.corpus).select(F.xxhash64("text").alias("ord"), "text")
    sets = [t.select("ord", shingles(tokens(F.col("text"))).alias("shingles")) for t in (rows, corpus)]
    flagged = [(r["ord"], r["overlap"]) for r in overlap.best_overlap(*sets, floor=args.threshold).filter(F.col("overlap") >= args.threshold).collect()]
    print(json.dumps({"n": len(pack), "flagged": [{"id": pack[k]["id"], "overlap": round(o, 4)} for k, o in flagged]}))
    return int(bool(flagged))


def _audit(args) -> int:
    """1 when fewer scenarios than asked for withstand the adversaries."""
    pack = readers.scenarios(Path(args.pack).read_text())
    robust = 0
    for s in pack:
        env = s["environment"]
        runs = [worlds.played(env["schema"], env.get("rows") or [], env.get("table"), actions, s["task"] if text is None else text, s["checkers"]) for actions, text in worlds.ADVERSARIES.values()]
        robust += not any(r["passed"] for r in runs)
    score = round(robust / (len(pack) or 1), 4)
    print(json.dumps({"n": len(pack), "robust": robust, "score": score, "fingerprint": provenance.pack_fingerprint(provenance.scenario_table(local_session("2"), pack)).first()["pack_fingerprint"]}))
    return int(score < args.min_robustness)


def _validate(args) -> int:
    """1 when a pack is too small, has equal ids or empty tasks."""
    pack = readers.scenarios(Path(args.pack).read_text())
    problems = [p for p, bad in (("fewer than 3 scenarios", len(pack) < 3), ("ids repeat", len({s.get("id") for s in pack}) < len(pack)), ("a task is empty", any(not str(s.get("task") or "").strip() for s in pack))) if bad]
    print(json.dumps({"n": len(pack), "problems": problems}))
    return int(bool(problems))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    verbs = top.add_subparsers(required=True)

    def verb(name, run, *arguments):
        one = verbs.add_parser(name, help=run.__doc__)
        for names, options in arguments:
            one.add_argument(*names, **options)
        one.set_defaults(run=run)

    verb("import", _import, (["path"], {}), (["out"], {}), (["--format"], {"default": "auto"}), (["--redact"], {"action": "store_true"}))
    verb("eval", _eval, (["path"], {}), (["--out"], {}))
    verb("export", _export, (["path"], {}), (["out"], {}), (["--format"], {"default": "jsonl", "choices": ["jsonl", "sharegpt", "adp", "parquet"]}))
    verb("diff", _diff, (["before"], {}), (["after"], {}), (["--ok"], {"action": "store_true"}))
    verb("contamination", _contamination, (["pack"], {}), (["corpus"], {}), (["--threshold"], {"type": float, "default": 0.8}))
    verb("audit", _audit, (["pack"], {}), (["--min-robustness"], {"type": float, "default": 0.0}))
    verb("validate", _validate, (["pack"], {}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
