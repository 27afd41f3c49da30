"""Configuration files of the training commands, read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class TrainingConfig:
    settings: dict
    first_template: str
    second_template: str


def _positive(settings: dict, *names: str) -> None:
    for name in names:
        value = settings.get(name)
        if not isinstance(value, int) or isinstance(value, bool) or value < 1:
            raise ValueError(f"{name} must be a positive whole number")


REQUIRED = ("outputDir", "rootDirs", "fileExtensions", "excludePatterns", "modelId", "concurrency")


def training_config(raw: str, tools: tuple[str, ...] = ()) -> TrainingConfig:
    """JSON between two ``---`` lines, then two prompt templates, the second below a ``# Phase 2:`` heading."""
    fenced = re.fullmatch(r"---\s*\n(.*?)\n---\s*\n?(.*)", raw, re.S)
    if not fenced:
        raise ValueError("expected settings between two --- lines")
    settings = json.loads(fenced[1])
    halves = re.split(r"(?m)^# Phase 2:.*\n", fenced[2].strip() + "\n", maxsplit=1)
    if len(halves) < 2 or not halves[0].strip():
        raise ValueError("a '# Phase 2:' heading must part the two templates")
    for name in REQUIRED:
        if settings.get(name) is None:
            raise ValueError(f"{name} is missing")
    for name in ("outputDir", "rootDirs", "modelId"):
        if not settings[name]:
            raise ValueError(f"{name} must not be empty")
    _positive(settings, "concurrency")
    first, second = re.sub(r"\A# Phase 1:.*\n", "", halves[0]).strip(), halves[1].strip()
    if not first or not second:
        raise ValueError("both templates must have text")
    settings.setdefault("maxHardNegatives", 5)
    for name in ("phase1Tools", "phase2Tools"):
        unknown = [t for t in settings.setdefault(name, []) if t not in tools]
        if unknown:
            raise ValueError(f"{name} has unknown tools: {', '.join(unknown)}")
    return TrainingConfig(settings, first, second)


def easy_negative_config(raw: str) -> dict:
    settings = json.loads(raw)
    if not settings.get("trainingSamplesDir"):
        raise ValueError("trainingSamplesDir must not be empty")
    _positive(settings, "minTopK", "maxTopK", "numNegatives", "concurrency")
    if settings["maxTopK"] <= settings["minTopK"]:
        raise ValueError("maxTopK must be greater than minTopK")
    return settings


def prompt(template: str, paths: list[str], blocks: list[str]) -> str:
    """A template with its list of files and their numbered texts."""
    listing = "\n".join(f"- {p}" for p in paths)
    return template.replace("{{FILE_LIST}}", listing, 1).replace("{{FILE_BLOCKS}}", "\n\n".join(blocks), 1)
