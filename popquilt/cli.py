"""Command line: ``python -m popquilt.cli STAGE COMMAND --root DIR [options]``."""

from __future__ import annotations

import argparse
import json
from datetime import date

from popquilt.functions.constants import RADII, RESOLUTIONS, UPSAMPLE
from popquilt.operators.model import Specification
from popquilt.plans import stages
from popquilt.session import session
from popquilt.sources.catalog import Catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="popquilt")
    groups = p.add_subparsers(dest="stage", required=True)

    def group(name: str):
        return groups.add_parser(name).add_subparsers(dest="command", required=True)

    def command(g, name: str, *options: str) -> argparse.ArgumentParser:
        c = g.add_parser(name)
        c.add_argument("--root", required=True)
        known = {
            "resolution": {"choices": RESOLUTIONS, "default": "100"},
            "version": {"required": True},
            "iso3": {"type": str.upper, "default": "all"},
            "year": {"default": "all"},
            "time_point": {"nargs": "+", "required": True},
            "denominator": {"nargs": "+", "required": True},
            "raking_version": {"default": "primary"},
            "copy_from_version": {},
        }
        for o in options:
            c.add_argument("--" + o.replace("_", "-"), dest=o, **known[o])
        return c

    g = group("preprocess")
    command(g, "census_data", "iso3", "year")
    c = command(g, "raking_data")
    c.add_argument("--out-version", default="primary")
    c.add_argument("--override", type=int, nargs="*", default=[])
    c.add_argument("--drop-children-of", type=int, nargs="*", default=[])
    g = group("model_prep")
    command(g, "modeling_frame", "resolution").add_argument("--info", type=json.loads)
    c = command(g, "features", "resolution")
    c.add_argument("--built-version", required=True)
    command(g, "night_lights", "resolution", "time_point")
    c = command(g, "averages", "resolution", "time_point")
    c.add_argument("--feature", required=True)
    c.add_argument("--radius", type=float, nargs="+", default=list(RADII))
    command(g, "training_data", "resolution", "time_point", "denominator").add_argument("--iso3-list", required=True, help="ISO:YEAR,ISO:YEAR")
    g = group("model")
    c = command(g, "train", "resolution", "denominator")
    c.add_argument("--feature", nargs="*", default=[])
    c.add_argument("--split", type=int, default=0)
    command(g, "inference", "resolution", "version", "time_point")
    g = group("postprocess")
    command(g, "raking_factors", "resolution", "version", "copy_from_version", "time_point", "raking_version").add_argument("--extrapolate", action="store_true")
    command(g, "rake", "resolution", "version", "time_point", "raking_version")
    command(g, "rake_itu", "resolution", "version", "iso3", "time_point", "raking_version")
    command(g, "mosaic", "resolution", "version", "time_point")
    command(g, "upsample", "resolution", "version", "time_point").add_argument("--spec-name", choices=sorted(UPSAMPLE), nargs="+", default=sorted(UPSAMPLE))
    command(group("validate"), "metrics", "resolution", "time_point").add_argument("--version", nargs="+", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    cat = Catalog(session(), a.root)
    run(cat, a)


def run(cat: Catalog, a: argparse.Namespace) -> None:
    if a.command == "census_data":
        stages.census_data(cat, a.iso3, a.year)
    elif a.command == "raking_data":
        stages.raking_data(cat, a.out_version, a.override, a.drop_children_of)
    elif a.command == "modeling_frame":
        stages.modeling_frame(cat, a.resolution, a.info)
    elif a.command == "features":
        stages.features(cat, a.resolution, a.built_version)
    elif a.command == "night_lights":
        stages.night_lights(cat, a.resolution, a.time_point)
    elif a.command == "averages":
        for t in a.time_point:
            stages.averages(cat, a.resolution, a.feature, t, a.radius)
    elif a.command == "training_data":
        years = dict(x.split(":") for x in a.iso3_list.split(","))
        for t in a.time_point:
            stages.training_data(cat, a.resolution, t, a.denominator, years)
    elif a.command == "train":
        for d in a.denominator:
            version = cat.next_version(a.resolution, date.today())
            stages.train(cat, Specification(d, a.resolution, a.feature, a.split, version=version))
            print(version)
    elif a.command == "inference":
        stages.inference(cat, a.resolution, a.version, a.time_point)
    elif a.command == "raking_factors":
        if a.copy_from_version:
            cat.copy_version(a.resolution, a.version, a.copy_from_version)
        times = sorted({*a.time_point, *(f"{y}q1" for y in range(1950, 2101))}) if a.extrapolate else a.time_point
        stages.raking_factors(cat, a.resolution, a.version, times, a.raking_version)
    elif a.command == "rake":
        stages.rake(cat, a.resolution, a.version, a.time_point, a.raking_version)
    elif a.command == "rake_itu":
        for t in a.time_point:
            stages.rake_fine(cat, a.resolution, a.version, a.iso3, t, a.raking_version)
    elif a.command == "mosaic":
        for t in a.time_point:
            view = stages.mosaic(cat, a.resolution, a.version, t).drop("group_key")
            cat.write(stages.raster.mosaic(view), "compiled_predictions", spec="mosaic")
    elif a.command == "upsample":
        for t in a.time_point:
            for s in a.spec_name:
                stages.upsample(cat, a.resolution, a.version, t, s)
    elif a.command == "metrics":
        for t in a.time_point:
            stages.metrics(cat, a.resolution, a.version, t)


if __name__ == "__main__":
    main()
