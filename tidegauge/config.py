"""Settings of a run, as a value that is checked once."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    """How many series to run and which, the optimiser's budget, and what is shown.

    sample_mode: "top" takes those of largest volume, "random" a seeded sample, "all" every one."""

    n_series: int = 100
    sample_mode: str = "top"
    seed: int = 42
    iterations: int = 100
    rate: float = 3e-2
    fold_rows: int = 200_000
    n_plot: int = 9
    horizon: int = 28

    def __post_init__(self):
        if self.sample_mode not in ("top", "random", "all"):
            raise ValueError(f"no sample mode {self.sample_mode!r}")
        for f in fields(self):
            if f.name not in ("sample_mode", "seed") and getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be positive")

    @classmethod
    def from_arguments(cls, arguments: list[str]) -> RunConfig:
        """From words such as ``--n-series 10 --sample-mode random``."""
        import argparse

        parser = argparse.ArgumentParser()
        for f in fields(cls):
            parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
        return cls(**vars(parser.parse_args(arguments)))
