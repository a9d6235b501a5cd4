"""Command line: learn, translate, audit, certify."""

from __future__ import annotations

import argparse
import json

from tessera.api import LearnConfig, certify, learn_pack, load_observations_jsonl, load_pack, load_stream, save_pack, translate_stream
from tessera.session import get_session, scratch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Learn symbol alphabets, translate code streams, certify packs.")
    sub = top.add_subparsers(dest="command", required=True)
    learn = sub.add_parser("learn", help="learn an alphabet from observations")
    learn.add_argument("observations")
    learn.add_argument("-o", "--output", required=True)
    learn.add_argument("--parent")
    for flag, kind, default in (("--n-symbols", int, 8), ("--min-cluster-size", int, 2), ("--tau-residual", float, 0.55), ("--seed", int, 0)):
        learn.add_argument(flag, type=kind, default=default)
    translate = sub.add_parser("translate", help="gloss a code stream with a pack")
    translate.add_argument("pack")
    translate.add_argument("stream")
    for name in ("audit", "certify"):
        check = sub.add_parser(name, help="print the certificate of a pack")
        check.add_argument("pack")
        check.add_argument("--tau-residual", type=float, default=0.55)
        check.add_argument("--allow-unglossed", action="store_true")
        if name == "certify":
            check.add_argument("--fail-on-undecodable", action="store_true")
    return top


def _show(value, **style) -> None:
    print(json.dumps(value, indent=2, **style))


def _learn(spark, args) -> int:
    knobs = {name: getattr(args, name) for name in ("n_symbols", "min_cluster_size", "tau_residual", "seed")}
    previous = load_pack(spark, args.parent) if args.parent else None
    pack = learn_pack(load_observations_jsonl(spark, args.observations), config=LearnConfig(**knobs), previous=previous)
    save_pack(pack, args.output)
    _show({"pack_id": pack.pack_id, "checksum": pack.checksum, "n_symbols": pack.symbols.count()})
    return 0


def _translate(spark, args) -> int:
    _show([gloss.to_dict() for gloss in translate_stream(load_pack(spark, args.pack), load_stream(spark, args.stream))])
    return 0


def _certify(spark, args) -> int:
    found = certify(load_pack(spark, args.pack), require_gloss=not args.allow_unglossed, tau_residual=args.tau_residual)
    _show(found.to_dict(), sort_keys=True)
    return int(getattr(args, "fail_on_undecodable", False) and not found.passed)


COMMANDS = {"learn": _learn, "translate": _translate, "audit": _certify, "certify": _certify}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or get_session()
    with scratch(spark):
        return COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
