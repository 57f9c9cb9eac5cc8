"""Settings from the environment, and the addresses allowed to call."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

# Defaults.
DEFAULT_ORIGINS = "http://localhost:3000,http://127.0.0.1:3000"


def parse_origins(raw: str) -> list[str]:
    """Stripped items between commas; blank ones don't count."""
    return [x for x in map(str.strip, raw.split(",")) if x]


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    model_dir: Path = Path("model")
    allowed_origins: tuple[str, ...] = tuple(parse_origins(DEFAULT_ORIGINS))
    host: str = "127.0.0.1"
    port: int = 8000
    request_timeout: int = 10

    @staticmethod
    def read(env: Mapping[str, str] | None = None, prefix: str = "TEXTLOOM_") -> Settings:
        """From variables with the prefix; what isn't set keeps its default."""
        env = os.environ if env is None else env
        own = Settings()
        get = lambda name, default: env.get(prefix + name, default)
        return Settings(
            environment=get("ENV", own.environment),
            model_dir=Path(get("MODEL_DIR", str(own.model_dir))).expanduser().resolve(),
            allowed_origins=tuple(parse_origins(get("ALLOWED_ORIGINS", DEFAULT_ORIGINS))),
            host=get("HOST", own.host),
            port=int(get("PORT", own.port)),
            request_timeout=int(get("REQUEST_TIMEOUT", own.request_timeout)),
        )


_settings: Settings | None = None


def settings() -> Settings:
    """Read once in a process."""
    global _settings
    if _settings is None:
        _settings = Settings.read()
    return _settings
