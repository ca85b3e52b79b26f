"""Weighted vocabularies, given by the user, compiled to regular expressions on the driver.

A configuration is a mapping (from YAML, say); toy() is a small one for examples and tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gazelark import fixed

_NEVER = r"(?!x)x"


def quote(term: str) -> str:
    """A term as a pattern that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9 _])", r"\\\1", term)


def stemmed(term: str) -> str:
    """A longer single word's closing e goes, so that the inflections cover donated and donating."""
    term = str(term).strip()
    return term[:-1] if len(term) > 4 and term.endswith("e") and " " not in term else term


def term_pattern(terms: list[str]) -> str:
    """One case-insensitive pattern for all terms, bounded and tolerant of inflections."""
    own = [quote(stemmed(t)) for t in terms if str(t).strip()]
    return f"(?i){fixed.TERM_LEFT}(?:{'|'.join(own)}){fixed.TERM_RIGHT}" if own else _NEVER


def consuming_pattern(terms: list[str]) -> str:
    """The same matches as a yes or no, without lookaround, for engines that lack it."""
    own = [quote(stemmed(t)) for t in terms if str(t).strip()]
    return "(?i)(^|[^A-Za-z0-9])(" + "|".join(own) + ")(e|es|ed|ing|s|d)?([^A-Za-z0-9]|$)" if own else "^$x"


@dataclass(frozen=True)
class Axis:
    name: str
    points: int
    terms: list[str]

    @property
    def pattern(self) -> str:
        return term_pattern(self.terms)


@dataclass(frozen=True)
class Stream:
    name: str
    axes: list[Axis]
    threshold: int = 4
    anchors: list[str] = field(default_factory=list)
    companions: list[str] = field(default_factory=list)
    min_title_axes: int = 0
    relevance_axis: str | None = None
    threshold_off_axis: int | None = None
    promise_axis: str | None = None


@dataclass(frozen=True)
class Lexicon:
    """streams in order of precedence: an item that several admit goes to the first."""

    streams: list[Stream]
    noise: list[str] = field(default_factory=list)
    promises: list[str] = field(default_factory=list)
    url_paths: list[str] = field(default_factory=list)
    bylines: list[str] = field(default_factory=list)
    money: str = r"\$|\bbillion\b|\bmillion\b"
    money_points: int = 1

    @staticmethod
    def from_config(config: dict, streams: tuple[tuple[str, str], ...] = (("major_gift", "gift"), ("watching", "watching"))) -> Lexicon:
        """streams: (name, prefix of its keys in the configuration)."""
        made = []
        for name, prefix in streams:
            axes = [Axis(a["name"], int(a["points"]), list(a.get("terms", []))) for a in config.get(f"{prefix}_axes", [])]
            off = config.get(f"{prefix}_threshold_off_axis")
            made.append(
                Stream(
                    name, axes, int(config.get(f"{prefix}_threshold", config.get("default_threshold", 4))),
                    list(config.get(f"{prefix}_require_anchor") or []), list(config.get(f"{prefix}_require_companion") or []),
                    int(config.get(f"{prefix}_min_title_axes", config.get("min_title_axes", 0))),
                    config.get(f"{prefix}_relevance_axis"), None if off is None else int(off), "giving" if prefix == "gift" else None,
                )
            )
        return Lexicon(made, list(config.get("noise", [])), list(config.get("gift_promise_terms", [])), list(config.get("noise_url_paths", [])), [b.lower() for b in config.get("byline_bypass", [])], config.get("money_pattern", Lexicon.money), int(config.get("money_points", 1)))

    @staticmethod
    def load(path: str) -> Lexicon:
        import yaml

        with open(path, encoding="utf-8") as f:
            return Lexicon.from_config(yaml.safe_load(f))


def toy() -> Lexicon:
    """Invented vocabularies over words that the invented documents have as well."""
    return Lexicon.from_config(
        {
            "gift_axes": [
                {"name": "giving", "points": 3, "terms": ["donate", "pledge", "bequest", "ention", "the"]},
                {"name": "recipient", "points": 2, "terms": ["museum", "hospital", "university", "that", "von"]},
                {"name": "gift_form", "points": 2, "terms": ["endowment", "grant", "with", "les"]},
            ],
            "gift_threshold": 4, "gift_require_anchor": ["giving"], "gift_require_companion": ["money", "recipient", "gift_form"], "gift_min_title_axes": 1,
            "watching_axes": [
                {"name": "convening", "points": 3, "terms": ["summit", "gala", "conference", "la", "der"]},
                {"name": "today", "points": 2, "terms": ["today", "tonight", "que", "und"]},
                {"name": "community", "points": 2, "terms": ["community", "neighbour", "los", "die"]},
            ],
            "watching_threshold": 4, "watching_require_anchor": ["convening", "today"], "watching_relevance_axis": "community", "watching_threshold_off_axis": 5,
            "noise": ["lottery", "horoscope", "worthless"], "gift_promise_terms": ["pledge"], "noise_url_paths": ["/src3/", "/sport/"],
        }
    )
