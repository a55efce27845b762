"""Settings of the command line, from environment variables that start with ``TESSERA_``."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What a command takes where its arguments don't say otherwise."""

    log_level: str = "WARN"
    document_index: str | None = None
    max_iterations: int = 3
    evidence_limit: int = 30
    discover_limit: int = 15
    batch_size: int = 30
    question_limit: int | None = None

    @classmethod
    def read(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        """The settings of an environment; a number that isn't one is an error."""
        found = {}
        for field in fields(cls):
            text = environment.get(f"TESSERA_{field.name.upper()}", "").strip()
            if text:
                found[field.name] = int(text) if "int" in str(field.type) else text
        return cls(**found)
