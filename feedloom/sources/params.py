"""Parameters of a run: a dataclass with defaults, and small text files as state."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields


@dataclass
class Parameters:
    daily_papers: int = 20
    scoring_batch_size: int = 10
    diversity_ratio: float = 0.3
    max_input_tokens: int = 30_000
    min_context_rounds: int = 2
    scheduled_time: str = "09:00"
    enabled: bool = True
    categories: tuple[str, ...] = ("cs.AI",)
    filter_keywords: tuple[str, ...] = ()


def expanded(value: str) -> str:
    """``$NAME`` and ``${NAME}`` from the environment; unknown names are empty."""
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: os.environ.get(m[1] or m[2], ""), value)


def parameters(given: dict) -> Parameters:
    """Defaults for what is absent; a given false or zero is kept. Unknown names are an error."""
    known = {f.name for f in fields(Parameters)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return Parameters(**{k: expanded(v) if isinstance(v, str) else v for k, v in given.items() if v is not None})


def read_state(path: str) -> str:
    """A state file's text, empty if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return ""


def write_state(path: str, text: str) -> None:
    """Replace a state file as a whole."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)
