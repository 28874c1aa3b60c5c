"""Settings of an analysis, passed explicitly: results never depend on the clock or the environment."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from . import rules


@dataclass(frozen=True)
class EngineConfig:
    """me: own address. now: epoch seconds that look-back windows end at."""

    me: str
    now: int
    my_name: str = "Me"
    coefficients: dict[str, float] = field(default_factory=lambda: dict(rules.COEFFICIENTS))
    lookback_days: int = rules.LOOKBACK_DAYS
    max_occurrences: int = rules.MAX_OCCURRENCES
    top_n: int = rules.BORDA_WINDOW

    def __post_init__(self):
        object.__setattr__(self, "me", self.me.strip().lower())
        if not self.me:
            raise ValueError("an own address is needed")


def read_env_file(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; comments and matching quotes are stripped; environ wins."""
    found: dict[str, str] = {}
    for line in Path(path).read_text().splitlines() if Path(path).exists() else []:
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            found[key] = value
    return found | {k: v for k, v in (environ or {}).items() if k in found}
