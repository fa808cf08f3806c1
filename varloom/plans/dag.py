"""Named datasets with declared dependencies, built lazily, kept as Parquet where wanted and rebuilt only when something changed.

A dataset's fingerprint covers its plan, the content of its files (size and modification
time of source files) and the fingerprints of its dependencies, so a change of code or
parameters is seen as well as a change of data.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from varloom.operators.joins import join_tables
from varloom.operators.pipe import Pipe, composite
from varloom.sources.tables import ParquetOut, ReadSpec, scan, write


@dataclass(frozen=True)
class Dataset:
    """name, names of dependencies, build(spark, inputs); keep: written as Parquet."""

    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    deps: tuple[str, ...] = ()
    keep: bool = False
    files: tuple[str, ...] = ()
    out: ParquetOut = field(default_factory=ParquetOut)


def source(name: str, path: str, spec: ReadSpec) -> Dataset:
    """A file or folder read by its format."""
    return Dataset(name, lambda spark, _: scan(spark, path, spec), files=(path,))


def piped(name: str, dep: str, pipes: Iterable[Pipe], keep: bool = False) -> Dataset:
    """Pipes applied to another dataset."""
    pipe = composite(tuple(pipes))
    return Dataset(name, lambda _, d: d[dep].transform(pipe), (dep,), keep)


def joined(name: str, left: str, right: str, how: str, left_on: list[str], right_on: list[str], keep: bool = False, **options) -> Dataset:
    """Equi-join of two datasets."""
    return Dataset(name, lambda _, d: join_tables(d[left], d[right], how, left_on, right_on, **options), (left, right), keep)


class Restricted(dict):
    """Inputs of a build: asking for an undeclared one raises."""

    def __missing__(self, key):
        raise KeyError(f"{key} is not a declared dependency")


class Catalog:
    """Datasets by name. Two different datasets with one name, unknown dependencies and cycles raise."""

    def __init__(self, datasets: Iterable[Dataset] = (), folder: str | None = None):
        self.datasets: dict[str, Dataset] = {}
        self.folder = Path(folder) if folder else None
        self.built: list[str] = []
        for d in datasets:
            self.add(d)

    def add(self, d: Dataset) -> None:
        if d.name in self.datasets and self.datasets[d.name] != d:
            raise ValueError(f"two datasets are named {d.name}")
        self.datasets[d.name] = d

    def order(self, targets: Iterable[str]) -> list[str]:
        """The targets and what they need, dependencies first."""
        done: dict[str, int] = {}
        out: list[str] = []

        def visit(n: str, path: tuple[str, ...]) -> None:
            if n not in self.datasets:
                raise KeyError(f"no dataset {n}, needed by {path[-1] if path else 'the caller'}")
            if done.get(n) == 1:
                raise ValueError(f"cycle: {' -> '.join((*path, n))}")
            if done.get(n) == 2:
                return
            done[n] = 1
            for dep in self.datasets[n].deps:
                visit(dep, (*path, n))
            done[n] = 2
            out.append(n)

        for t in targets:
            visit(t, ())
        return out

    def descendants(self, names: Iterable[str]) -> set[str]:
        """The named datasets and all that depend on them."""
        out = set(names)
        while more := {d.name for d in self.datasets.values() if set(d.deps) & out} - out:
            out |= more
        return out

    def _fingerprint(self, d: Dataset, df: DataFrame, prints: dict[str, str]) -> str:
        files = []
        for f in d.files:
            for p in sorted([Path(f)] if Path(f).is_file() else Path(f).rglob("*")):
                if p.is_file():
                    files.append((str(p), p.stat().st_size, p.stat().st_mtime_ns))
        plan = re.sub(r"#\d+L?|plan_id=\d+|\[id=\d+\]", "", df._jdf.queryExecution().analyzed().toString())
        for dep in d.deps:
            if self.folder:
                plan = plan.replace(str(self.folder / dep), dep)
        return hashlib.sha256(json.dumps([plan, files, [prints[x] for x in d.deps]]).encode()).hexdigest()

    def run(self, spark: SparkSession, targets: Iterable[str], must_rebuild: Iterable[str] = ()) -> dict[str, DataFrame]:
        """DataFrames of the targets. Kept datasets are written unless their fingerprint is the one on record; must_rebuild names are written anew, with all that depends on them."""
        forced = self.descendants(must_rebuild)
        frames: dict[str, DataFrame] = {}
        prints: dict[str, str] = {}
        targets = list(targets)
        self.built = []
        for n in self.order(targets):
            d = self.datasets[n]
            df = d.build(spark, Restricted({x: frames[x] for x in d.deps}))
            prints[n] = self._fingerprint(d, df, prints)
            if d.keep:
                if self.folder is None:
                    raise ValueError("kept datasets need a folder")
                path, record = self.folder / n, self.folder / f"{n}.fingerprint"
                same = path.exists() and record.exists() and record.read_text() == prints[n]
                if not same or n in forced:
                    work = self.folder / f".{n}.new"
                    write(df, str(work), d.out, "overwrite")
                    record.unlink(missing_ok=True)
                    old = self.folder / f".{n}.old"
                    shutil.rmtree(old, ignore_errors=True)
                    if path.exists():
                        os.replace(path, old)
                    os.replace(work, path)
                    shutil.rmtree(old, ignore_errors=True)  # only once the new one is in place
                    record.write_text(prints[n])
                    self.built.append(n)
                df = spark.read.parquet(str(path))
            frames[n] = df
        return {t: frames[t] for t in targets}
