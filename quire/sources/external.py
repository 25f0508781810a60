"""An external layout parser as a child process of the driver: options by profile, a time limit, its one result file."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, fields, replace
from pathlib import Path

LAYOUT_ENDING = "_middle.json"
TIMEOUT_SECONDS = 3600
ERROR_CHARS = 4000


class ParserRunError(RuntimeError):
    """The parser failed, took too long, or left no single result."""


@dataclass(frozen=True)
class ParserOptions:
    """What a run is asked for; None leaves the parser's own default."""

    backend: str | None = None
    method: str = "auto"
    effort: str | None = None
    formula: bool | None = None
    table: bool | None = None
    image_analysis: bool | None = None
    url: str | None = None
    start_page: int | None = None
    end_page: int | None = None


# What each profile stands for.
PROFILES = {
    "fast-text": ParserOptions("pipeline", "txt", "medium", False, False, False),
    "balanced": ParserOptions(),
    "accurate": ParserOptions("hybrid-engine", "auto", "high", True, True, True),
    "local-gpu": ParserOptions("vlm-engine", "auto", "high", True, True, True),
    "remote-gpu": ParserOptions("hybrid-http-client", "auto", "medium", True, True, True),
}


def resolve_options(profile: str | None = None, **given: object) -> ParserOptions:
    """A profile's options; those given and not None win."""
    name = profile or "balanced"
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return replace(PROFILES[name], **{k: v for k, v in given.items() if v is not None})


def arguments(options: ParserOptions) -> list[str]:
    """Options as ``--name value`` arguments, those that are None left out."""
    out = []
    for f in fields(options):
        if (value := getattr(options, f.name)) is not None:
            out += [f"--{f.name.replace('_', '-')}", str(value).lower() if isinstance(value, bool) else str(value)]
    return out


def run_parser(command: list[str], source: Path, work: Path, options: ParserOptions | None = None, timeout: float = TIMEOUT_SECONDS) -> Path:
    """Runs ``command`` on ``source`` into ``work`` and returns its layout JSON; ``timeout`` 0 waits for ever."""
    work.mkdir(parents=True, exist_ok=True)
    try:
        done = subprocess.run([*command, "-p", str(source), "-o", str(work), *arguments(options or ParserOptions())], capture_output=True, text=True, timeout=timeout or None)
    except FileNotFoundError as problem:
        raise ParserRunError(f"{command[0]} is not installed") from problem
    except subprocess.TimeoutExpired as problem:
        raise ParserRunError(f"{command[0]} took more than {timeout:g} s on {source.name}") from problem
    if done.returncode:
        raise ParserRunError(f"{command[0]} failed on {source.name}: {(done.stderr or done.stdout)[-ERROR_CHARS:]}")
    found = sorted(work.rglob(f"*{LAYOUT_ENDING}"))
    if len(found) != 1:
        raise ParserRunError(f"{command[0]} left {len(found)} layout files for {source.name}")
    return found[0]
