"""Provenance on the driver: canonical JSON, hashes, staged publication, run status, receipts, frozen policies."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as stream:
        while part := stream.read(block):
            found.update(part)
    return found.hexdigest()


def within(root: str | Path, path: str | Path) -> Path:
    """The resolved path, if it lies below the root."""
    root, full = Path(root).resolve(), (Path(root) / path).resolve()
    if root != full and root not in full.parents:
        raise ValueError(f"{path} leaves {root}")
    return full


def load_config(path: str | Path, required: dict[str, type], pinned: dict[str, Any] | None = None) -> dict[str, Any]:
    """A JSON object that has the required keys, of their kinds, and the pinned values."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    for key, kind in required.items():
        if key not in config:
            raise ValueError(f"{path} lacks {key}")
        if not isinstance(config[key], kind):
            raise ValueError(f"{key} of {path} is no {kind.__name__}")
    for key, value in (pinned or {}).items():
        if config.get(key) != value:
            raise ValueError(f"{key} of {path} must be {value!r}")
    return config


def write_json(path: str | Path, value: Any) -> None:
    """Written beside and moved into place, so a reader never sees half a file."""
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as stream:
        stream.write(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n")
    os.replace(name, path)


STATES = {"RUNNING": {"COMPLETED", "FAILED", "NEEDS_REVIEW"}, "COMPLETED": {"RUNNING"}, "FAILED": {"RUNNING"}, "NEEDS_REVIEW": {"RUNNING"}}


def write_status(path: str | Path, state: str, **details: Any) -> None:
    """Moves a run from one state to the next; other moves raise."""
    path = Path(path)
    before = json.loads(path.read_text())["state"] if path.exists() else None
    if before is None and state != "RUNNING" or before is not None and state not in STATES[before]:
        raise ValueError(f"a run can't go from {before} to {state}")
    write_json(path, {"state": state, **details})


@contextlib.contextmanager
def staged(target: str | Path, inputs: dict[str, str] | None = None, validate: Callable[[Path], None] | None = None) -> Iterator[Path]:
    """A folder to write into; it replaces ``target`` only if the inputs still have their hashes and it passes ``validate``."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}."))
    try:
        yield stage
        for path, expected in (inputs or {}).items():
            if file_sha256(path) != expected:
                raise RuntimeError(f"{path} changed during the run")
        if validate:
            validate(stage)
        old = None
        if target.exists():
            old = target.with_name(f".{target.name}.old")
            os.replace(target, old)
        os.replace(stage, target)
        if old:
            shutil.rmtree(old)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def fingerprint(inputs: list[str | Path], code: list[str | Path], versions: dict[str, str]) -> str:
    """One hash over inputs, code and versions."""
    return digest({"inputs": {str(p): file_sha256(p) for p in inputs}, "code": {Path(p).name: file_sha256(p) for p in code}, "versions": versions})


def frozen_state(target: str | Path, current: str) -> str:
    """absent, reused (same fingerprint), or an error for output of another fingerprint."""
    path = Path(target) / "fingerprint.json"
    if not Path(target).exists():
        return "absent"
    if not path.exists() or json.loads(path.read_text()).get("fingerprint") != current:
        raise RuntimeError(f"{target} was made from other inputs")
    return "reused"


def manifest_of(root: str | Path) -> dict[str, str]:
    """Hash of every file below a folder, by relative path."""
    root = Path(root)
    return {str(p.relative_to(root)): file_sha256(p) for p in sorted(root.rglob("*")) if p.is_file()}


def changed(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str]]:
    """(path, what) of every file that was added, removed or altered."""
    out = [(p, "added") for p in after.keys() - before.keys()] + [(p, "removed") for p in before.keys() - after.keys()]
    return sorted(out + [(p, "altered") for p in before.keys() & after.keys() if before[p] != after[p]])


def claim_receipt(path: str | Path, hashes: dict[str, str]) -> str:
    """``claimed`` for the first run; ``resumed`` for one with the same hashes; anything else raises."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        if json.loads(Path(path).read_text())["hashes"] == hashes:
            return "resumed"
        raise RuntimeError("this was run once with other inputs") from None
    with os.fdopen(handle, "w") as stream:
        stream.write(canonical_json({"hashes": hashes}))
    return "claimed"


def prohibited(root: str | Path, patterns: tuple[str, ...]) -> list[str]:
    """Files whose names match a pattern."""
    return sorted({str(p.relative_to(root)) for pattern in patterns for p in Path(root).rglob(pattern) if p.is_file()})


def freeze(path: str | Path, policy: dict[str, Any]) -> str:
    """Writes a policy with its own hash; one that exists must be the same."""
    sealed = {"policy": policy, "sha256": digest(policy)}
    if Path(path).exists():
        if json.loads(Path(path).read_text()) != sealed:
            raise RuntimeError("another policy is frozen")
    else:
        write_json(path, sealed)
    return sealed["sha256"]


def thaw(path: str | Path) -> dict[str, Any]:
    """A frozen policy, if its hash still fits."""
    sealed = json.loads(Path(path).read_text())
    if digest(sealed["policy"]) != sealed["sha256"]:
        raise RuntimeError("the frozen policy was altered")
    return sealed["policy"]


def amend(old: str | Path, new: str | Path, changes: dict[str, Any], reason: str) -> str:
    """A successor of a frozen policy that names the one before it, what changes, and why."""
    before = thaw(old)
    unknown = changes.keys() - before.keys()
    if unknown:
        raise ValueError(f"the policy has no {sorted(unknown)}")
    return freeze(new, {**before, **changes, "amends": digest(before), "changed": sorted(changes), "reason": reason})
