"""What may be plugged in from outside: generation, search, page reading, encoding.  None is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.errors import ConfigError


@runtime_checkable
class TextFunction(Protocol):
    """Texts in, texts out; one object serves a task from its first batch to its last."""

    def __call__(self, texts: list[str]) -> list[str]: ...


@runtime_checkable
class SearchProvider(Protocol):
    """A query in, hits (title, url, snippet) out."""

    def search(self, query: str, limit: int) -> list[dict]: ...


@runtime_checkable
class Encoder(Protocol):
    """Texts in, unit vectors out."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


def apply_text(df: DataFrame, column: str, out: str, factory: Callable[[], TextFunction]) -> DataFrame:
    """``out`` from ``column`` by an outside function; a row whose call fails gets null and the failure in ``<out>_error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for frame in frames:
            values, errors = [], []
            for text in frame[column]:
                try:
                    values.append(call([text])[0])
                    errors.append(None)
                except Exception as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(**{out: values, f"{out}_error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` string, `{out}_error` string")


def encode(df: DataFrame, column: str, out: str, factory: Callable[[], Encoder], batch: int = 128) -> DataFrame:
    """Vectors of texts, in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for frame in frames:
            texts = frame[column].fillna("").tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in encoder.encode(texts[at : at + batch])]
            yield frame.assign(**{out: vectors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def retry(call: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] | None = None):
    """The call's result, after up to ``tries`` tries with linearly longer waits; the last failure is raised."""
    import time

    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            (sleep or time.sleep)(wait * n)


def choose(kind: str, adapters: dict[str, Callable]) -> Callable:
    """The named adapter; an unknown name is an error."""
    if kind not in adapters:
        raise ConfigError(f"unknown retrieval adapter {kind!r}; known: {', '.join(sorted(adapters))}")
    return adapters[kind]


@dataclass(frozen=True)
class RunConfig:
    """A training run's settings; the defaults are those of a full run."""

    max_rounds: int = 25
    num_generations: int = 4
    batch_size: int = 4
    max_steps: int = 1
    use_vllm: bool = False
    trace_path: str | None = None
    trace_exists: bool = False
    append_trace: bool = False


# Rounds, generations and steps of the runs that are known.
RUNS = {
    "smoke": RunConfig(max_rounds=2, num_generations=2, batch_size=2, max_steps=1),
    "pilot": RunConfig(max_rounds=8, num_generations=4, max_steps=10),
    "template_pilot": RunConfig(max_rounds=4, num_generations=4, max_steps=10),
    "formal": RunConfig(max_rounds=4, num_generations=4, max_steps=100),
}


def read_config(path: str) -> dict:
    """A YAML file whose root is a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise ConfigError("the root of a configuration must be a mapping")
    return config
