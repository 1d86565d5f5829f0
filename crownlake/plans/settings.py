"""Places of a trial's files, and the command line of the two plans."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from .pipeline import Settings


def flag(text: str) -> bool:
    """true, 1, yes, y, t and their opposites, in any case."""
    low = text.strip().lower()
    if low in ("true", "1", "yes", "y", "t"):
        return True
    if low in ("false", "0", "no", "n", "f"):
        return False
    raise argparse.ArgumentTypeError(f"neither true nor false: {text}")


@dataclass(frozen=True)
class Paths:
    """Inputs and outputs of a trial below one folder, which may lie on any file system."""

    root: str
    trial: str

    def __getattr__(self, name: str) -> str:
        places = {"points": "points", "dsm": "dsm", "chm": "chm", "labels": "labels", "clusters": "clusters", "clusters_csv": "clusters.csv", "deep_csv": "deep_clusters.csv", "multimatch": "multimatch", "results": "results"}
        if name not in places:
            raise AttributeError(name)
        return f"{self.root}/{self.trial}/{places[name]}"


#: The earlier one-script run: an own half-metre raster, a fixed smoothing and a fixed width of the cost.
LEGACY = Settings(resolution=0.5, smooth_sigma=1.0, gps_sigma=4.0)


def clustering_parser() -> argparse.ArgumentParser:
    """An option for each setting of a clustering, and the trial's place."""
    p = argparse.ArgumentParser(prog="crownlake clustering")
    p.add_argument("--root", required=True)
    p.add_argument("--trial_name", required=True)
    for name, value in Settings.__dataclass_fields__.items():
        p.add_argument(f"--{name}", type=type(value.default), default=value.default)
    p.add_argument("--save", type=flag, default=False)
    return p


def training_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="crownlake training")
    p.add_argument("--root", required=True)
    p.add_argument("--trial_name", required=True)
    for name in ("advanced", "smote", "weighting", "selection", "tuning"):
        p.add_argument(f"--{name}", type=flag, default=name in ("weighting", "selection"))
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    return Settings(**{n: getattr(args, n) for n in Settings.__dataclass_fields__})
