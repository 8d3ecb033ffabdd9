"""Command line: python -m fusionweft --csv FILE --ats FILE [--config FILE] [--output FILE]."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys

from ..session import local_session
from ..sources.delimited import DelimitedSource
from ..sources.documents import DocumentSource
from ..sources.rest import Fetcher, ProfileSource, fetched, http_get
from .config import ConfigError, ProjectionConfig, load_config
from .pipeline import Pipeline, as_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fusionweft", description=__doc__)
    p.add_argument("--csv", help="delimited file")
    p.add_argument("--ats", help="JSON document")
    p.add_argument("--profiles", help="landed profiles (JSON lines); with --repos")
    p.add_argument("--repos", help="landed repositories (JSON lines)")
    p.add_argument("--github", action="append", default=[], metavar="URL", help="profile to fetch (login or link; may be repeated); GITHUB_TOKEN is used if set")
    p.add_argument("--config", help="projection configuration (YAML)")
    p.add_argument("--no-provenance", action="store_true")
    p.add_argument("--no-confidence", action="store_true")
    p.add_argument("--output", "-o", help="file for the result; else standard output")
    p.add_argument("--pretty", action="store_true", default=True)
    p.add_argument("--summary", action="store_true")
    p.add_argument("--log-level", default="WARNING")
    p.add_argument("--log-file")
    return p


def summary(result: dict) -> str:
    lines = [f"{'candidate':<18} {'name':<25} {'confidence':<22}"]
    for c in result["candidates"]:
        conf = float(c.get("overall_confidence") or 0)
        lines.append(f"{c['candidate_id']:<18} {str(c.get('full_name') or '-')[:25]:<25} {'#' * int(conf * 20):<20} {conf:.3f}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper(), filename=args.log_file)
    if not (args.csv or args.ats or args.profiles or args.github):
        print("no source given", file=sys.stderr)
        return 1
    try:
        config = load_config(args.config) if args.config else ProjectionConfig()
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    config = dataclasses.replace(config, provenance=config.provenance and not args.no_provenance, confidence=config.confidence and not args.no_confidence)
    spark = local_session()
    sources = [kind(path) for kind, path in ((DelimitedSource, args.csv), (DocumentSource, args.ats)) if path]
    if args.profiles:
        profiles = spark.read.schema("login string, status int, name string, email string, bio string, company string, blog string, location string").json(args.profiles)
        repos = spark.read.schema("login string, pos int, language string, size bigint, fork boolean").json(args.repos) if args.repos else spark.createDataFrame([], "login string, pos int, language string, size bigint, fork boolean")
        sources.append(ProfileSource(profiles, repos))
    if args.github:
        sources.append(fetched(spark, args.github, Fetcher(http_get(os.environ.get("GITHUB_TOKEN")))))
    whole = Pipeline(sources, config).run(spark).to_dict()  # computed once; all that follows reads it
    text = as_json(whole)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    if args.summary:
        print(summary(whole), file=sys.stderr)
    return int(whole["candidates_failed"] > 0)
