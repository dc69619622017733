"""Settings as a dataclass of literals, read from the environment with a typed fallback."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_files: int = 20
    max_upload_mb: int = 30
    max_pages: int = 30
    render_dpi: int = 220
    layout_quality: float = 0.58
    layout_min_blocks: int = 1
    decode_rescue: float = 0.55
    review_enabled: bool = True
    review_max_units: int = 6
    review_max_pixels: int = 3_000_000
    review_max_chars: int = 12_000


def read(env: Mapping[str, str] | None = None, prefix: str = "QUIRE_") -> Settings:
    """Settings named prefix + NAME; a text that is no number leaves the default, and 1, true, yes, on are true."""
    env, found = os.environ if env is None else env, {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        if isinstance(f.default, bool):
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        else:
            try:
                found[f.name] = type(f.default)(raw)
            except ValueError:
                pass
    return Settings(**found)
