"""Pipeline runner: sources, then ordered steps, with a summary; a failing part does not stop the others."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

log = logging.getLogger("hearthmill")


@dataclass(frozen=True)
class Settings:
    """Everything a run can be told."""

    data_root: str = "."
    source: str = "all"
    force_full: bool = False
    retries: int = 2
    backoff_seconds: float = 10.0
    threads: int = 1


@dataclass
class Summary:
    results: dict[str, object] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return int(bool(self.errors))


def with_retries(f: Callable[[], object], retries: int, backoff_seconds: float, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call ``f``; after an error wait once, twice, ... the backoff and try again; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return f()
        except Exception:
            if attempt == retries:
                raise
            sleep(backoff_seconds * (attempt + 1))
    raise AssertionError("unreachable")


def run(steps: dict[str, Callable[[Settings], object]], settings: Settings, only: list[str] | None = None, stop_on_error: bool = False) -> Summary:
    """Run steps in order; ``only`` selects some of them by name."""
    out = Summary()
    for name, step in steps.items():
        if only is not None and name not in only:
            continue
        began = time.time()
        try:
            out.results[name] = step(settings)
        except Exception as e:
            log.exception("step %s failed", name)
            out.errors[name] = f"{type(e).__name__}: {e}"
            if stop_on_error:
                break
        finally:
            out.seconds[name] = time.time() - began
    return out


def sql_scripts(spark, scripts: dict[str, str]) -> dict[str, Callable[[Settings], object]]:
    """Steps from SQL texts; each text may hold several statements parted by semicolons at line ends."""

    def step(text: str) -> Callable[[Settings], object]:
        def go(_: Settings) -> int:
            parts = [p.strip() for p in text.split(";\n")]
            done = [spark.sql(p.rstrip(";")) for p in parts if p.strip(" ;\n")]
            return len(done)

        return go

    return {name: step(text) for name, text in scripts.items()}


def parse_args(argv: list[str] | None = None) -> Settings:
    p = argparse.ArgumentParser(prog="hearthmill")
    p.add_argument("--data-root", default=".")
    p.add_argument("--source", choices=["all", "listings", "cubes"], default="all")
    p.add_argument("--force-full", action="store_true")
    p.add_argument("--threads", type=int, default=1)
    a = p.parse_args(argv)
    return Settings(a.data_root, a.source, a.force_full, threads=a.threads)
