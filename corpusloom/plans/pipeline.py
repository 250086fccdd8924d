"""Pipelines of named steps over tables, with a range of steps, reuse of results and dry runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import exists

# The names that each mode goes by.
TOKENIZERS = {
    "code": "pinyin-code", "codes": "pinyin-code", "pinyin-code": "pinyin-code", "initial": "pinyin-initial", "initials": "pinyin-initial",
    "pinyin-initial": "pinyin-initial", "hanzi": "hanzi",
}


def mode_of(name: str) -> str:
    """The normal form of a mode's name."""
    try:
        return TOKENIZERS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown mode {name!r}") from None


@dataclass
class Pipeline:
    """Steps (name, key, function of the last result). A step whose (name, key) has run before gives its result again.

    folder: where results are written as tables; a step whose table is there whole is not run but read, so that a
    run that has ended early is taken up again.
    """

    steps: list[tuple[str, str, Callable[[DataFrame | None], DataFrame]]]
    done: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    folder: str | None = None

    def result(self, name: str, key: str, step: Callable[[DataFrame | None], DataFrame], last: DataFrame | None) -> DataFrame:
        if (name, key) not in self.done:
            self.done[name, key] = step(last) if self.folder is None else self.written(f"{self.folder}/{name}-{key}", step, last)
        return self.done[name, key]

    def written(self, path: str, step: Callable[[DataFrame | None], DataFrame], last: DataFrame | None) -> DataFrame:
        spark = SparkSession.active()
        if not exists(spark, f"{path}/_SUCCESS"):
            step(last).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def selected(self, start_at: str | None = None, stop_after: str | None = None) -> list[str]:
        names = [s[0] for s in self.steps]
        for name in (start_at, stop_after):
            if name is not None and name not in names:
                raise ValueError(f"unknown step {name!r}")
        a = names.index(start_at) if start_at else 0
        b = names.index(stop_after) if stop_after else len(names) - 1
        if a > b:
            raise ValueError(f"{start_at!r} comes after {stop_after!r}")
        return names[a : b + 1]

    def run(self, first: DataFrame | None = None, start_at: str | None = None, stop_after: str | None = None, dry_run: bool = False) -> DataFrame | None:
        chosen, result = self.selected(start_at, stop_after), first
        for name, key, step in self.steps:
            if name not in chosen:
                continue
            if dry_run:
                print(f"{name} ({key})")
            else:
                result = self.result(name, key, step, result)
        return result


def run_matrix(tokenizers: list[str], architectures: list[str], base: str) -> list[tuple[str, str, str]]:
    """(tokenizer, architecture, run name), the tokenizer outermost; repeats are left out and equal names are an error."""
    pairs = list(product(dict.fromkeys(tokenizers), dict.fromkeys(architectures)))
    names = [base if len(pairs) == 1 else f"{base}-{t}-{a}" for t, a in pairs]
    if len(set(names)) < len(names):
        raise ValueError("two runs have the same name")
    return [(t, a, n) for (t, a), n in zip(pairs, names, strict=True)]
