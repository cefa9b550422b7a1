"""Run settings and their checks."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``chunk_lines``: lines a chunk; the other three steer the pattern split."""

    output: str = "./output"
    chunk_lines: int = 100_000
    threads: int = 4
    most_representatives: int = 40
    split_all_up_to: int = 3
    least_dominance: float = 0.6

    def __post_init__(self) -> None:
        if not self.output or self.output.startswith("-"):
            raise ValueError("output must be a path that does not start with '-'")
        for name in ("chunk_lines", "threads", "most_representatives", "split_all_up_to"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 < self.least_dominance < 1:
            raise ValueError("least_dominance must lie between 0 and 1")


#: Slots from which a split's rows are not folded any more (fixed value of the data model).
FOLD_BELOW = 15
#: Digits of a number that is kept as an integer (fixed value of the data model).
NUMBER_DIGITS = 15
#: Rows looked at when an encoding is chosen (fixed value of the data model).
SAMPLE_ROWS = 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Structure, archive and restore text logs with Spark.")
    p.add_argument("-o", dest="output", default="./output", help="archive folder")
    p.add_argument("-c", dest="chunk_lines", type=int, default=100_000, help="lines a chunk")
    p.add_argument("-t", dest="threads", type=int, default=4, help="local threads, where no master is set")
    p.add_argument("-rt", dest="most_representatives", type=int, default=40, help="a slot with as many representative values is not split")
    p.add_argument("-z", dest="split_all_up_to", type=int, default=3, help="a slot with at most so many values is split on all of them")
    p.add_argument("-dt", dest="least_dominance", type=float, default=0.6, help="share of rows that representatives must exceed")
    p.add_argument("--restore", action="store_true", help="restore an archive to text instead")
    p.add_argument("--legacy", action="store_true", help="also write the portable per-chunk .tar.xz files")
    p.add_argument("file", help="text log, or archive to restore")
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    names = ("output", "chunk_lines", "threads", "most_representatives", "split_all_up_to", "least_dominance")
    return Settings(**{n: getattr(args, n) for n in names})
