"""Boundaries to speech and language models: protocols, registries and deterministic fakes.

An implementation is injected and runs batch-wise on the executors; one instance serves a Python worker."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from chronotext.config import PrivacyConfig

from .validate import require_private


class ProviderError(ValueError):
    pass


class Transcriber(Protocol):
    def transcribe(self, content: bytes, hotwords: str | None) -> list[tuple[float, float, str]]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str, schema: str | None) -> tuple[str, dict[str, int]]: ...


class FakeTranscriber:
    """A segment for every ten seconds' worth of bytes; its text is a digest of them."""

    def transcribe(self, content: bytes, hotwords: str | None = None) -> list[tuple[float, float, str]]:
        parts = [content[i : i + 320_000] for i in range(0, len(content), 320_000)]
        return [(10.0 * k, 10.0 * k + len(p) / 32_000, hashlib.sha256(p).hexdigest()[:12]) for k, p in enumerate(parts)]


class EchoModel:
    """Answers with the prompt's last line."""

    def complete(self, prompt: str, schema: str | None = None) -> tuple[str, dict[str, int]]:
        answer = prompt.rstrip("\n").rpartition("\n")[2]
        return answer, {"input_tokens": len(prompt), "output_tokens": len(answer)}


TRANSCRIBERS: dict[str, Callable[[], Transcriber]] = {"fake": FakeTranscriber}
MODELS: dict[str, Callable[[], LanguageModel]] = {"fake": EchoModel}
LOCAL = ("fake", "faster_whisper")


def transcriber(name: str, cfg: PrivacyConfig = PrivacyConfig()) -> Callable[[], Transcriber]:
    if name not in TRANSCRIBERS:
        raise ProviderError(f"unknown transcriber {name}")
    require_private("audio", name, LOCAL, cfg)
    return TRANSCRIBERS[name]


def language_model(name: str, cfg: PrivacyConfig = PrivacyConfig()) -> Callable[[], LanguageModel]:
    if name not in MODELS:
        raise ProviderError(f"unknown model {name}")
    require_private("transcript", name, LOCAL, cfg)
    return MODELS[name]


def transcribe(files: DataFrame, make: Callable[[], Transcriber], hotwords: str | None = None) -> DataFrame:
    """session_id, id, seg_start, seg_end, text of files (session_id, content): trimmed, empty ones dropped, in order."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for s, content in zip(b.session_id, b.content, strict=True):
                found = sorted((a, e, t.strip()) for a, e, t in model.transcribe(bytes(content), hotwords) if t.strip() and a <= e)
                out += [(s, k, *x) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["session_id", "id", "seg_start", "seg_end", "text"])

    kind = files.schema["session_id"].dataType.simpleString()
    return files.select("session_id", "content").mapInPandas(rows, f"session_id {kind}, id int, seg_start double, seg_end double, text string")


def complete(units: DataFrame, make: Callable[[], LanguageModel], retries: int = 2, base_seconds: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """units with response, usage, attempts and error; a failed call is tried again after base * 2^attempt seconds."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for prompt in b.prompt:
                for attempt in range(retries + 1):
                    try:
                        text, usage = model.complete(prompt, None)
                        out.append((text, usage, attempt + 1, None))
                        break
                    except Exception as e:  # noqa: BLE001  a provider may raise anything
                        if attempt == retries:
                            out.append((None, {}, attempt + 1, str(e)))
                        else:
                            sleep(base_seconds * 2**attempt)
            yield b.assign(**{k: [r[i] for r in out] for i, k in enumerate(("response", "usage", "attempts", "error"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInPandas(rows, f"{schema}, response string, usage map<string,bigint>, attempts int, error string")
