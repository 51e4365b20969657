"""Command line: breaklines of a point file."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from . import __version__
from .config import ExtractConfig
from .plans.extract import extract
from .session import local_session, ship


#: Options that have had names of their own before; every other parameter is named after its field.
SHORT = {"min_face_area_m2": "min-area", "min_line_length_m": "min-length", "slope_low_deg": "slope-low", "slope_high_deg": "slope-high"}


def _several(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(",") if x.strip())


def parser() -> argparse.ArgumentParser:
    """The input, the folder for results, and one option for each parameter of a run."""
    p = argparse.ArgumentParser(prog="cragline", description="Crest and toe lines of steep faces in a point cloud")
    p.add_argument("input", help="LAS, XYZ, TXT, CSV or Parquet file")
    p.add_argument("-o", "--output", required=True, help="folder for the results")
    p.add_argument("--all-classes", action="store_true", help="use every class, not ground only")
    p.add_argument("--version", action="version", version=__version__)
    for f in fields(ExtractConfig):
        if f.name != "use_ground_class":
            kind = {int: int, float: float}.get(type(f.default), _several)
            p.add_argument("--" + SHORT.get(f.name, f.name.replace("_", "-")), dest=f.name, type=kind, default=f.default, help=f"default {f.default}")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    chosen = {f.name: getattr(a, f.name) for f in fields(ExtractConfig) if f.name != "use_ground_class"}
    cfg = ExtractConfig(**chosen, use_ground_class=not a.all_classes).checked()
    spark = local_session()
    ship(spark)
    result = extract(spark, a.input, a.output, cfg, lambda pct, what: print(f"{pct:5.1f} % {what}", flush=True))
    print(json.dumps({k: result[k] for k in ("faces_detected", "crest_lines", "toe_lines", "elapsed_s")}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
