"""Where a library keeps its files, from environment variables with a common prefix."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "SONOLITH_"


@dataclass(frozen=True)
class Settings:
    """catalog: database of the catalogue's tables; library: folder of the audio files; cache: folder of the frame
    tables; mixes: folder of rendered mixes."""

    catalog: str = "default"
    library: str = "data/library"
    cache: str = "data/cache"
    mixes: str = "data/mixes"

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings of an environment (the process's own by default); variables that are missing or empty keep the
        defaults, unknown ones are ignored."""
        env = os.environ if env is None else env
        named = {f.name: env.get(PREFIX + f.name.upper()) for f in fields(cls)}
        return cls(**{n: v for n, v in named.items() if v})
