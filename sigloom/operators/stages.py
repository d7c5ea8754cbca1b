"""Stereo stems through models that may be mono-only, and runs of stages that keep each stage's table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Peak in dB under which a stem counts as silent and is left alone.
SILENT_DB = -45.0


def decibels(x: np.ndarray) -> float:
    level = float(np.sqrt(np.mean(x * x))) if x.size else 0.0
    return 20 * np.log10(level) if level > 0 else float("-inf")


def clean_stems(stems: DataFrame, load: Callable[[], Callable], mode: str = "auto") -> DataFrame:
    """(sig, y, strategy, residual): each stem (sig, x array<array<double>>, an array a channel) through a model.

    ``load()`` runs once a partition and returns ``f(channels x samples) -> channels x samples``. A model that gives one
    channel for two is mono-only: under ``auto`` the stem is done again as mid and side, and later stems of the partition
    at once; ``mid_side`` always works so, ``joint`` never. strategy: joint, mid_side, skipped (silent, empty or null
    stems) or failed (the model raised RuntimeError); the last two return the stem as it was, with a residual of minus
    infinity. residual is the level of what was taken away against the stem's, both as mono. A wrong channel count in the
    end raises ValueError. Output is cut to the stem's length, what is missing at its end comes from the stem.
    """
    if mode not in ("auto", "joint", "mid_side"):
        raise ValueError(f"unknown mode {mode}")

    def fitted(y, x: np.ndarray) -> np.ndarray:
        y = np.atleast_2d(np.asarray(y, float))[:, : x.shape[1]]
        rest = x[:, y.shape[1] :]
        return np.hstack([y, rest if len(rest) == len(y) else np.repeat(rest.mean(0, keepdims=True), len(y), 0)])

    def halves(model, x: np.ndarray) -> np.ndarray:
        mid, side = (fitted(model(v), v) for v in ((x[:1] + x[1:]) / 2, (x[:1] - x[1:]) / 2))
        return np.vstack([mid + side, mid - side])

    def run(parts):
        import pandas as pd

        model, mono_only = load(), False
        for part in parts:
            out = []
            for sig, rows in zip(part.sig, part.x, strict=True):
                x = np.array([np.asarray(c, float) for c in rows]) if rows is not None and len(rows) else np.zeros((0, 0))
                peak = float(np.abs(x).max()) if x.size else 0.0
                if peak < 10 ** (SILENT_DB / 20):
                    out.append((sig, x.tolist(), "skipped", float("-inf")))
                    continue
                pair = len(x) == 2
                try:
                    if pair and (mode == "mid_side" or mode == "auto" and mono_only):
                        y, how = halves(model, x), "mid_side"
                    else:
                        y, how = fitted(model(x), x), "joint"
                        if pair and mode == "auto" and len(y) == 1:
                            mono_only = True
                            y, how = halves(model, x), "mid_side"
                except RuntimeError:
                    out.append((sig, x.tolist(), "failed", float("-inf")))
                    continue
                if len(y) != len(x):
                    raise ValueError(f"stem {sig}: {len(x)} channels became {len(y)}")
                out.append((sig, y.tolist(), how, decibels((x - y).mean(0)) - decibels(x.mean(0))))
            yield pd.DataFrame(out, columns=["sig", "y", "strategy", "residual"])

    return stems.select("sig", "x").mapInPandas(run, "sig long, y array<array<double>>, strategy string, residual double")


def run_stages(source: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame] | None]], folder: str) -> dict[str, DataFrame]:
    """The table of each stage by name, in order: written to ``folder/name`` in place of an earlier run's, and read again.

    Every stage works on its predecessor's table; a stage that is None is left out. ``folder`` has to be one that all
    executors share.
    """
    names = [name for name, _ in stages]
    if len(set(names)) < len(names):
        raise ValueError("stages need different names")
    now, found = source, {}
    for name, stage in stages:
        if stage is None:
            continue
        path = f"{folder}/{name}"
        stage(now).write.mode("overwrite").parquet(path)
        now = found[name] = source.sparkSession.read.parquet(path)
    return found


def only_one(results: DataFrame) -> DataFrame:
    """``results``; fails unless it has exactly one row. At most two rows are looked at."""
    n = len(results.limit(2).select(F.lit(1)).collect())
    if n != 1:
        raise ValueError("no result" if not n else "more than one result")
    return results
