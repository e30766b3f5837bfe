"""Options of the four programs: mapping, partitioning, deep mapping, dynamic mapping."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from meshwork.functions.hierarchy import Machine
from meshwork.plans.solver import PROFILES, Profile


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("meshwork")
    sub = out.add_subparsers(dest="program", required=True)
    for name in ("map", "partition", "deep", "dynamic"):
        p = sub.add_parser(name)
        if name != "dynamic":
            p.add_argument("--graph", required=True, help="METIS file, or a folder of Parquet tables vertices and edges")
        else:
            p.add_argument("--commands", required=True, help="command log, or - for standard input")
        if name == "partition":
            p.add_argument("--k", type=int, required=True)
        else:
            p.add_argument("--hierarchy", required=True, help="a1:a2:...:al, innermost level first")
            p.add_argument("--distance", required=True, help="d1:d2:...:dl")
        p.add_argument("--imbalance", type=float, default=0.03)
        p.add_argument("--config", choices=sorted(PROFILES), default="fast")
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--mapping", help="folder for the placement, a block for each line")
        p.add_argument("--json-output", help="folder for the summary")
        p.add_argument("--save-coarsest-graph", help="folder for the coarsest graph")
        p.add_argument("--items", help="folder for the index of the parts of the machine's levels")
        p.add_argument("--dataset", help="folder of the collection that graph, placement and figures are added to")
        if name == "map":
            p.add_argument("--hm-level", type=int, default=0, help="how many outermost levels are split before solving")
        for f in fields(Profile):
            p.add_argument(f"--{f.name}", type=type(f.default), help=f"instead of the profile's {f.name}")
    return out


def profile_of(args: argparse.Namespace) -> Profile:
    """The profile with single options put over it."""
    given = {f.name: getattr(args, f.name) for f in fields(Profile) if getattr(args, f.name) is not None}
    return replace(PROFILES[args.config], **given)


def machine_of(args: argparse.Namespace) -> Machine:
    return Machine.flat(args.k) if args.program == "partition" else Machine.parse(args.hierarchy, args.distance)
