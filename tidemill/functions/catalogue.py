"""Declarations of features and labels: TOML tables with a definition and the data a value may have seen."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from tidemill.functions.clock import DURATIONS

FEATURE_KEYS = ("definition", "information_set", "lag", "normalization", "source_datasets", "notes", "version", "introduced")
LABEL_KEYS = ("horizon", "computation", "information_set", "embargo", "notes", "version", "introduced")


@dataclass(frozen=True)
class Sight:
    """What a value may use: so many ns back (None: not bounded in time), so many updates back, so many ns ahead; and a setting that widens its null mask."""

    back: int | None = 0
    updates: int = 0
    ahead: int = 0
    widened_by: str | None = None


def _duration(token: str) -> int:
    if token not in DURATIONS:
        raise ValueError(f"unknown duration {token!r}")
    return DURATIONS[token]


def sight(text: str) -> Sight:
    """Reads `t`, `[t-1s, t]`, `[prev_l1_update, t]`, `data through t + 10s`, and the last with a second clause on the null mask; anything else raises."""
    if text == "t":
        return Sight()
    if text == "[prev_l1_update, t]":
        return Sight(back=None, updates=1)
    if text.startswith("[t-") and text.endswith(", t]"):
        return Sight(back=_duration(text[3:-4]))
    value, _, mask = text.partition("; ")
    words = value.split(" ")
    if words[:4] != ["data", "through", "t", "+"] or words[5:] not in ([], ["for", "the", "VALUE"]) or bool(words[5:]) != bool(mask):
        raise ValueError(f"no reading of {text!r}")
    ahead = _duration(words[4])
    if not mask:
        return Sight(ahead=ahead)
    found = mask.split(f"t + {words[4]} + ", 1)
    setting = found[1].split(" ", 1)[0] if len(found) == 2 else ""
    if setting != "label_gap.max_quote_gap_seconds":
        raise ValueError(f"the null mask of {text!r} names no known setting")
    return Sight(ahead=ahead, widened_by=setting)


def embargo(text: str) -> int:
    if not text.startswith(">= "):
        raise ValueError(f"no reading of {text!r}")
    return _duration(text[3:])


@dataclass(frozen=True)
class Entry:
    name: str
    body: dict

    @property
    def sight(self) -> Sight:
        return sight(self.body["information_set"])


def load(path: str | Path, keys: tuple[str, ...]) -> dict[str, Entry]:
    """The entries of a TOML file; each must have these keys (others may stand beside them), and a label's embargo must cover its horizon."""
    out = {}
    for name, body in tomllib.loads(Path(path).read_text()).items():
        if missing := set(keys) - set(body):
            raise ValueError(f"{name}: keys missing: {sorted(missing)}")
        entry = Entry(name, body)
        if "embargo" in body and (embargo(body["embargo"]) < entry.sight.ahead or _duration(body["horizon"]) != entry.sight.ahead):
            raise ValueError(f"{name}: embargo and horizon do not fit what it has seen")
        out[name] = entry
    return out


def get(entries: dict[str, Entry], name: str) -> Entry:
    if name not in entries:
        raise KeyError(f"{name} is not in the catalogue: {sorted(entries)}")
    return entries[name]


def markdown(entries: dict[str, Entry], column: str) -> str:
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    rows = [f"| {cell(n)} | {cell(e.body[column])} | {cell(e.body['information_set'])} |" for n, e in entries.items()]
    return "\n".join([f"| name | {column} | information set |", "|---|---|---|", *rows]) + "\n"
