"""Label definitions: checks, identity and what a change of them asks for."""

from __future__ import annotations

import json
from typing import Any

from ..functions.jsontools import canonical_sha256

MAX_LABELS, MAX_LABEL_BYTES = 4096, 256
REQUIRED = ("schema", "name", "version", "judgment_type", "options", "io")
#: Fixed fields of a definition and of its parts; every other one is refused.
KNOWN = frozenset((*REQUIRED, "instruction", "base_model", "acceptance", "limits", "out_of_scope_label", "baseline_comparison"))
OPTION = frozenset(("id", "display_name", "description"))
#: Fixed upper bounds: basis points of the accuracy that is asked for, microseconds of the waiting time.
MOST_BP, MOST_P95_US = 10_000, 3_600_000_000


def load(text: str, most_bytes: int = 1 << 20) -> dict[str, Any]:
    """A definition from JSON: no repeated or unknown keys, the required fields, options with unique non-empty ids, in their order, and parts within their bounds."""
    if len(text.encode()) > most_bytes:
        raise ValueError("the definition is too large")

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError("the definition repeats a key")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=unique)
    missing = [k for k in REQUIRED if k not in found] if isinstance(found, dict) else list(REQUIRED)
    if missing:
        raise ValueError(f"the definition lacks {', '.join(missing)}")
    if unknown := sorted(found.keys() - KNOWN):
        raise ValueError(f"the definition has unknown fields: {', '.join(unknown)}")
    options = found["options"]
    if not isinstance(options, list) or not all(isinstance(o, dict) and "id" in o and o.keys() <= OPTION and all(isinstance(x, str) for x in o.values()) for o in options):
        raise ValueError("an option is no object of the strings id, display_name and description")
    check_labels([o["id"] for o in options])
    for name in ("name", "judgment_type"):
        if not isinstance(found[name], str) or not found[name]:
            raise ValueError(f"{name} must be a text")
    if not isinstance(found["io"], dict):
        raise ValueError("io must be an object")
    if "acceptance" in found:
        least = found["acceptance"].get("min_accuracy_bp") if isinstance(found["acceptance"], dict) else None
        if set(found["acceptance"] or ()) != {"min_accuracy_bp"} or type(least) is not int or not 0 <= least <= MOST_BP:
            raise ValueError("acceptance must hold min_accuracy_bp, 0 to 10000")
    if "limits" in found:
        limits = found["limits"]
        bounds = {"max_infer_p95_us": MOST_P95_US, "max_package_bytes": (1 << 63) - 1}
        if not isinstance(limits, dict) or not limits or not limits.keys() <= bounds.keys() or any(type(x) is not int or not 1 <= x <= bounds[k] for k, x in limits.items()):
            raise ValueError("limits are out of range")
    if "out_of_scope_label" in found and found["out_of_scope_label"] not in [o["id"] for o in options]:
        raise ValueError("the out-of-scope label is no option")
    return found


def check_labels(labels: list[Any]) -> None:
    if not labels or len(labels) > MAX_LABELS:
        raise ValueError("the number of labels is out of range")
    if any(not isinstance(x, str) or not x or len(x.encode()) > MAX_LABEL_BYTES for x in labels):
        raise ValueError("a label is no string, empty or too long")
    if len(set(labels)) != len(labels):
        raise ValueError("labels repeat")


def identity(definition: dict[str, Any]) -> str:
    return canonical_sha256(definition)


def rebuild(old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
    """Whether a model must be built anew: unchanged, required (with reasons), or cosmetic (with the ids whose texts changed)."""
    if identity(old) == identity(new):
        return {"decision": "unchanged"}
    before, after = {o["id"]: o for o in old["options"]}, {o["id"]: o for o in new["options"]}
    reasons = [name for name, key in (("type", "judgment_type"), ("base_model", "base_model"), ("instruction", "instruction")) if old.get(key) != new.get(key)]
    removed, added = [k for k in before if k not in after], [k for k in after if k not in before]
    if removed or added:
        reasons.insert(0, "options")
    if reasons:
        return {"decision": "required", "reasons": reasons, "removed": removed, "added": added}
    return {"decision": "cosmetic", "changed": [k for k in before if before[k] != after[k]]}
