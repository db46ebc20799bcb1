"""Commands: ``run CAPTURE OUT``, ``repeat A B``, ``overlay A B SVG``, ``calibrate A B [A B ...]``; plans are JSON documents."""

from __future__ import annotations

import argparse
import json

import pandas as pd

from .operators import compare


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scanloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="capture to plan")
    run.add_argument("capture")
    run.add_argument("out")
    run.add_argument("--detections")
    run.add_argument("--no-drift", action="store_true")
    run.add_argument("--no-calibration", action="store_true")
    for name, more in (("repeat", []), ("overlay", ["svg"])):
        c = commands.add_parser(name)
        for arg in ("a", "b", *more):
            c.add_argument(arg)
    commands.add_parser("calibrate").add_argument("plans", nargs="+")
    args = parser.parse_args(argv)
    if args.command == "run":
        from .pipeline import run_capture
        from .session import send_package, session

        spark = session()
        send_package(spark)
        plan = run_capture(spark, args.capture, args.out, detections=args.detections, drift_rounds=0 if args.no_drift else 2, calibrated=not args.no_calibration)
        print(f"{len(plan['rooms'])} rooms, {plan['footprint_area_m2']['value']} m²")
    elif args.command == "repeat":
        print(compare.markdown(compare.compare(load(args.a), load(args.b)), args.a, args.b))
    elif args.command == "overlay":
        a, b = load(args.a), load(args.b)
        with open(args.svg, "w", encoding="utf-8") as f:
            f.write(compare.overlay_svg(a, b, compare.register(a, b)[0]))
    else:
        if len(args.plans) % 2:
            parser.error("plans come in pairs")
        pairs = pd.concat([compare.calibration_pairs(load(a), load(b)) for a, b in zip(args.plans[::2], args.plans[1::2], strict=True)])
        for kind, rows in pairs.groupby("kind"):
            value, covered = compare.tau(rows)
            print(json.dumps({"kind": kind, "tau": value, "pairs": len(rows), "loo_coverage": covered}))


if __name__ == "__main__":
    main()
