"""Where generated data comes from: a record that is checked before the data is."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame

from ..functions.times import RFC3339_UTC


@dataclass(frozen=True)
class Provenance:
    model: str
    prompt_sha256: str
    generated_at: datetime
    input_tokens: int | None
    output_tokens: int | None
    source: str | None


def parse(text: str) -> Provenance:
    """A record from one JSON object. Usage must be named and may be null (not observed); other keys are allowed."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate_key")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=unique)
    if not isinstance(found, dict):
        raise ValueError("not_an_object")

    def required(name: str) -> str:
        if name not in found:
            raise ValueError(f"missing_field {name}")
        if not isinstance(found[name], str) or not found[name]:
            raise ValueError(f"invalid_field {name}")
        return found[name]

    model, prompt, time = required("model_requested"), required("prompt_sha256"), required("started_utc")
    if not re.fullmatch("[0-9a-f]{64}", prompt):
        raise ValueError("invalid_field prompt_sha256")
    if not re.fullmatch(RFC3339_UTC.strip("^$"), time):
        raise ValueError("invalid_field started_utc")
    at = datetime.strptime(time[:19], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC)
    if fraction := re.search(r"\.([0-9]{1,9})", time):
        at = at.replace(microsecond=int(fraction[1].ljust(6, "0")[:6]))
    if "usage_observed" not in found:
        raise ValueError("missing_field usage_observed")
    usage = found["usage_observed"]
    tokens: list[int | None] = [None, None]
    if usage is not None:
        if not isinstance(usage, dict):
            raise ValueError("invalid_field usage_observed")
        for i, name in enumerate(("input_tokens", "output_tokens")):
            n = usage.get(name)
            if isinstance(n, bool) or not isinstance(n, int) or n < 0:
                raise ValueError(f"invalid_field usage_observed.{name}")
            tokens[i] = n
    source = found.get("source")
    if "source" in found and (not isinstance(source, str) or not source):
        raise ValueError("invalid_field source")
    return Provenance(model, prompt, at, *tokens, source)


def ingest(record: Provenance, disallowed_sources: set[str], load: Callable[[], DataFrame]) -> DataFrame:
    """load(), unless the record names a source that must not train a model; then nothing is read."""
    if record.source in disallowed_sources:
        raise ValueError("disallowed_source")
    return load()
