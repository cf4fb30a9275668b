"""Options of a run: defaults, file, command line."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import PurePath
from typing import Any

# Options and their defaults.
@dataclass(frozen=True)
class Options:
    engine: str = "local"
    model: str = "qwen3:8b"
    service_url: str = "http://localhost:11434"
    hosted_url: str = ""
    hosted_key: str = ""
    hosted_model: str = "openai/gpt-4o-mini"
    client_key: str = ""
    client_model: str = "gemini-2.0-flash"
    source_lang: str = "ja"
    target_lang: str = "zh"
    batch_pages: int = 10
    translate_batch_pages: int = 3
    chunk_min_tokens: int = 400
    chunk_max_tokens: int = 600
    chunk_max_items: int = 15
    cache_db: str = "translation_cache.db"
    page_start: int | None = None
    page_end: int | None = None
    no_ocr: bool = False
    use_gpu: bool = True
    ocr_engine: str = "both"
    ocr_lang: str = "japan"
    ocr_confidence: float = 0.1
    text_threshold: float = 0.7
    low_text: float = 0.4
    min_size: int = 10
    canvas_size: int = 4096
    output_suffix: str = "_translated"
    ocr_only: bool = False
    stage: str = "full"
    extract_dpi: int = 300
    cluster_algorithm: str = "simple"
    line_spacing_ratio: float = 1.5
    column_gap: float = 50.0
    threads: dict[str, int] = field(default_factory=lambda: {"ocr": 2, "translator": 1})

    def backend(self) -> tuple[str, dict[str, Any]]:
        """Name and arguments of the translation backend for ``create_backend``."""
        if self.engine == "hosted":
            return "hosted", {"url": self.hosted_url, "key": self.hosted_key, "model": self.hosted_model}
        return "local", {"url": self.service_url, "model": self.model}

    def merged(self, values: dict[str, Any]) -> Options:
        """Known keys of ``values`` that are not None; an absent flag leaves the option as it is."""
        known = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in values.items() if k in known and v is not None})


def load_options(path: str | None) -> Options:
    """Options from a YAML file; a missing or malformed file gives the defaults, unknown keys are ignored."""
    if not path:
        return Options()
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return Options()
    try:
        import yaml

        values = yaml.safe_load(text)
    except ImportError:
        values = dict(_plain(text))
    except Exception:  # noqa: BLE001  any YAML error means defaults
        return Options()
    return Options().merged(values) if isinstance(values, dict) else Options()


def _plain(text: str):  # noqa: ANN202
    """key: value lines, for systems without a YAML reader."""
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        value = value.split("#")[0].strip().strip("'\"")
        if colon and value and not line.startswith((" ", "#")):
            yield key.strip(), {"true": True, "false": False}.get(value.lower(), int(value) if value.lstrip("-").isdigit() else value)


def output_path(source: str, suffix: str = "_translated") -> str:
    p = PurePath(source)
    return str(p.with_name(p.stem + suffix + p.suffix))
