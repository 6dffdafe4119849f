"""Settings of the scanner, with YAML and environment overrides."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Stage:
    enabled: bool = True


@dataclass(frozen=True)
class Separators(Stage):
    spans: str = "token"  # words within stretches without white space; "message": also across them, as in "k i l l"


@dataclass(frozen=True)
class Leetspeak(Stage):
    max_expansions: int = 1024


@dataclass(frozen=True)
class Repetition(Stage):
    threshold: int = 2
    collapse_patterns: bool = True


@dataclass(frozen=True)
class Fuzzy(Stage):
    max_distance: int = 2
    min_word_length: int = 4
    distance_ratio: float = 0.25
    max_checks: int = 500  # 0: no budget; words near a token are then found by an index
    distance: str = "edits"  # or "doubled", see operators.fuzzy.distance_of


@dataclass(frozen=True)
class Tier:
    label: str
    threshold: float
    action: str


# The tiers that the scanner applies, and the lower ones that its documents promise.
TIERS = (Tier("low", 0.0, "log"), Tier("medium", 0.6, "flag"), Tier("high", 0.8, "warn"), Tier("critical", 1.0, "block"))
DOCUMENTED_TIERS = (Tier("low", 0.0, "log"), Tier("medium", 0.3, "flag"), Tier("high", 0.6, "warn"), Tier("critical", 0.8, "block"))


@dataclass(frozen=True)
class Reporting:
    retention_days: int = 90
    export_limit: int = 10_000
    webhook_url: str = ""


@dataclass(frozen=True)
class Logging:
    level: str = "info"
    format: str = "text"


@dataclass(frozen=True)
class Config:
    """tiers rise by threshold; score at or above the last one that is reached counts."""

    leetspeak: Leetspeak = Leetspeak()
    homoglyph: Stage = Stage()
    separator_bypass: Stage = Separators()
    repetition: Repetition = Repetition()
    fuzzy: Fuzzy = Fuzzy()
    tiers: tuple[Tier, ...] = TIERS
    tier_mode: str = "configured"  # or "documented": DOCUMENTED_TIERS in place of tiers
    reporting: Reporting = Reporting()
    logging: Logging = Logging()
    case_sensitive: bool = False
    max_message_length: int = 10_000
    max_words: int = 100_000
    max_word_length: int = 256
    word_list_path: str = ""
    default_base_score: float = 0.5
    environment: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.tier_mode not in ("configured", "documented"):
            raise ValueError(f"tier_mode {self.tier_mode!r} is neither 'configured' nor 'documented'")

    @property
    def severities(self) -> tuple[Tier, ...]:
        """The tiers that count under tier_mode."""
        return DOCUMENTED_TIERS if self.tier_mode == "documented" else self.tiers

    @staticmethod
    def load(path: str | None = None) -> Config:
        """Defaults, overridden by the YAML file at path or $CONFIG_PATH if there is one; unknown keys are logged and ignored.

        Keys are this class's own, or a service's tree of sections (detection, word_list, reporting, logging). $WORD_LIST_PATH
        and $REPORT_PATH are kept for Lexicon.configured() and ReportTable.configured().
        """
        path = path or os.environ.get("CONFIG_PATH")
        found = {}
        if path and os.path.exists(path):
            import yaml

            with open(path, encoding="utf-8") as lines:
                found = yaml.safe_load(lines) or {}
        names = {k: os.environ[k] for k in ("WORD_LIST_PATH", "REPORT_PATH") if k in os.environ}
        return replace(_override(Config(), _flat(found)), environment=names)


# Names in a service's file that differ from the names here.
_RENAMED = {"collapse_threshold": "threshold", "max_checks_per_message": "max_checks"}


def _flat(found: dict) -> dict:
    """The sections of a service's file as keys of Config; a file without sections stays as it is."""
    out = {k: v for k, v in found.items() if k not in ("detection", "word_list", "server")}
    detection = dict(found.get("detection") or {})
    scoring = detection.pop("scoring", None) or {}
    out |= {k: {_RENAMED.get(x, x): y for x, y in v.items()} if isinstance(v, dict) else v for k, v in detection.items()}
    if "tiers" in scoring:
        out["tiers"] = [{"label": t.get("label", "low"), "threshold": t.get("threshold", 0.0), "action": t.get("action", "log")} for t in scoring["tiers"]]
    if "tier_mode" in scoring:
        out["tier_mode"] = scoring["tier_mode"]
    words = found.get("word_list") or {}
    out |= {k: words[k] for k in ("max_words", "max_word_length") if k in words}
    return out | ({"word_list_path": words["default_path"]} if "default_path" in words else {})


def _override(old, new: dict):
    known = {f.name for f in fields(old)}
    changes = {}
    for key, value in new.items():
        if key not in known or key == "environment":
            logging.getLogger(__name__).warning("setting %s is not known", key)
            continue
        current = getattr(old, key)
        if key == "tiers":
            value = tuple(Tier(**x) for x in value)
        elif is_dataclass(current):
            value = _override(current, value or {})
        changes[key] = value
    return replace(old, **changes)
