"""Settings of a crawl: what is given, else the environment, else defaults; checked once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

LEVELS = ("off", "error", "warn", "info", "debug", "trace")


def read_bool(text: str) -> bool:
    """1, true, 0 or false, in any case."""
    known = {"1": True, "true": True, "0": False, "false": False}
    if text.strip().lower() not in known:
        raise ValueError(f"{text!r} is neither true nor false")
    return known[text.strip().lower()]


def read_level(text: str) -> str:
    if text.strip().lower() not in LEVELS:
        raise ValueError(f"{text!r} is no log level; known are {', '.join(LEVELS)}")
    return text.strip().lower()


def mib(text: str) -> int:
    """Bytes of a number of MiB; more than 64 bits hold is an error."""
    n = int(text) * (1 << 20)
    if not 0 <= n < 1 << 64:
        raise ValueError(f"{text} MiB can't be counted in bytes")
    return n


@dataclass(frozen=True)
class Config:
    storage_dir: str = "./storage"
    purge_on_start: bool = True
    log_level: str = "info"
    memory_bytes: int | None = None
    min_concurrency: int = 1
    max_concurrency: int = 200
    max_retries: int = 3
    max_rotations: int = 10
    persist_seconds: float = 60.0
    idle_seconds: float = 0.1

    def checked(self) -> Config:
        """This, or a ValueError that names the first setting which can't be used."""
        if self.min_concurrency < 1:
            raise ValueError("min_concurrency must be at least 1")
        if self.max_concurrency < self.min_concurrency:
            raise ValueError("max_concurrency is below min_concurrency")
        for name in ("persist_seconds", "idle_seconds"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        for name in ("max_retries", "max_rotations"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        return self


#: Environment variable, setting, reader.
ENVIRONMENT = [
    ("CRAWLFRAME_STORAGE_DIR", "storage_dir", str), ("CRAWLFRAME_PURGE_ON_START", "purge_on_start", read_bool), ("CRAWLFRAME_LOG_LEVEL", "log_level", read_level),
    ("CRAWLFRAME_MEMORY_MIB", "memory_bytes", mib), ("CRAWLFRAME_MIN_CONCURRENCY", "min_concurrency", int), ("CRAWLFRAME_MAX_CONCURRENCY", "max_concurrency", int),
]


def resolve(given: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """Settings given, then the environment's, then defaults. Unknown names and values that can't be read raise ValueError."""
    given, environment = dict(given or {}), os.environ if environment is None else environment
    unknown = given.keys() - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found = {}
    for variable, name, reader in ENVIRONMENT:
        if name not in given and variable in environment:
            try:
                found[name] = reader(environment[variable])
            except ValueError as e:
                raise ValueError(f"{variable}: {e}") from e
    return replace(Config(), **(found | given)).checked()
