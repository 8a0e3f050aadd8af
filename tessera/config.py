"""Settings, from defaults and environment variables that start with TESSERA_."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    store: str = "warehouse/prices"
    user_agent: str = "tessera"
    confidence: float = 0.99
    window: int = 252
    step: int = 21
    cost_bps: float = 2.0

    @staticmethod
    def load() -> Settings:
        own = {f.name: type(f.default)(v) for f in fields(Settings) if (v := os.environ.get(f"TESSERA_{f.name.upper()}")) is not None}
        return Settings(**own)
