"""Settings from environment variables CODELOOM_<NAME>, after a .env file of the same names."""

from __future__ import annotations

import dataclasses
import functools
import json
import logging
import os
from pathlib import Path

PREFIX = "CODELOOM_"


@dataclasses.dataclass(frozen=True)
class Settings:
    workdir: Path = Path(".codeloom")
    log_level: str = "INFO"
    log_format: str = "console"
    git_timeout_seconds: int = 300
    sandbox_default_timeout: int = 60

    def __post_init__(self) -> None:
        if self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR") or self.log_format not in ("json", "console"):
            raise ValueError(f"log_level {self.log_level!r}, log_format {self.log_format!r}")

    @classmethod
    def load(cls, env_file: str = ".env") -> Settings:
        found: dict[str, str] = {}
        if os.path.isfile(env_file):
            lines = Path(env_file).read_text(encoding="utf-8").splitlines()
            found = {k.strip(): v.strip().strip("\"'") for k, eq, v in (x.partition("=") for x in lines) if eq and not k.lstrip().startswith("#")}
        found |= os.environ
        known = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        return cls(**{n: _typed(kind, found[PREFIX + n.upper()]) for n, kind in known.items() if PREFIX + n.upper() in found})


def _typed(kind: type, text: str):  # noqa: ANN202
    return kind(text) if kind in (int, str) else Path(text)


@functools.lru_cache(maxsize=1)
def settings() -> Settings:
    """The process's settings; `settings.cache_clear()` forgets them."""
    return Settings.load()


def configure_logging(chosen: Settings | None = None) -> None:
    chosen = chosen or settings()
    handler = logging.StreamHandler()
    handler.setFormatter(_JsonLines() if chosen.log_format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    root = logging.getLogger("codeloom")
    root.handlers, root.level = [handler], logging.getLevelName(chosen.log_level)


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})
