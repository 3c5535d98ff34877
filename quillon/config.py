"""Configuration on the driver: taxonomy, scoring and pipeline settings, checked when they are loaded."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

CONF = Path(__file__).parent / "conf"
DETECTORS = ("lexicon", "regex", "regex_unless", "cooccurrence", "repetition", "entity_blame", "entity_sentiment_split")


@dataclass(frozen=True)
class Category:
    id: str
    detector: str
    name: str = ""
    family: str = ""
    base_confidence: float = 0.8
    severity_weight: float = 0.5
    disruption: float = 0.3
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    unless_terms: tuple[str, ...] = ()
    unless_patterns: tuple[str, ...] = ()
    min_hits: int = 2
    max_words: int = 15
    ngram_size: int = 3
    min_repeats: int = 3
    entity_labels: tuple[str, ...] = ("PERSON", "ORG", "NORP", "GPE")
    group_terms: tuple[str, ...] = ()
    min_blamed_sentences: int = 2
    positive_threshold: float = 0.5
    negative_threshold: float = -0.5
    min_entities: int = 2
    min_mentions: int = 2

    @property
    def needs_entities(self) -> bool:
        return self.detector.startswith("entity_")


@dataclass(frozen=True)
class Taxonomy:
    categories: tuple[Category, ...]
    default_threshold: float = 0.8
    version: str = ""

    @property
    def ids(self) -> list[str]:
        return [c.id for c in self.categories]

    @property
    def needs_entities(self) -> bool:
        return any(c.needs_entities for c in self.categories)

    def by_id(self, key: str) -> Category:
        return {c.id: c for c in self.categories}[key]

    def families(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for c in self.categories:
            out.setdefault(c.family, []).append(c.id)
        return out


@dataclass(frozen=True)
class Scoring:
    lam: float = 4.0
    beta: float = 0.5
    places: int = 6
    expose_composite: bool = False
    method: str = "smooth_max"
    gamma: float = 4.0
    alpha: float = 1.0
    weights: dict = field(default_factory=dict)
    increments: dict = field(default_factory=dict)
    families: dict = field(default_factory=dict)
    bands: dict = field(default_factory=lambda: {"low": 0.3, "moderate": 0.7})

    def members(self, taxonomy: Taxonomy, composite: str) -> list[str]:
        wanted = set(self.families.get(composite, []))
        return [c.id for c in taxonomy.categories if c.family in wanted]


def load_yaml(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def digest(value: object) -> str:
    """SHA-256 of the JSON with sorted keys: the same for any order of keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def taxonomy(raw: dict | None = None) -> Taxonomy:
    """ValueError for a missing list of categories, a missing or repeated id, an unknown detector, an empty rule list."""
    raw = load_yaml(CONF / "taxonomy.yaml") if raw is None else raw
    if not raw.get("categories"):
        raise ValueError("taxonomy: no categories")
    known, out = set(Category.__dataclass_fields__), []
    for entry in raw["categories"]:
        key = entry.get("id")
        if not key or key in {c.id for c in out}:
            raise ValueError(f"taxonomy: category id missing or repeated: {key!r}")
        if entry.get("detector") not in DETECTORS:
            raise ValueError(f"{key}: unknown detector {entry.get('detector')!r}")
        c = Category(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items() if k in known})
        rules = {"lexicon": c.terms, "cooccurrence": c.terms, "entity_blame": c.terms, "regex": c.patterns, "regex_unless": c.patterns}.get(c.detector, (1,))
        if not rules or c.detector == "regex_unless" and not (c.unless_terms or c.unless_patterns):
            raise ValueError(f"{key}: a {c.detector} category needs its lists")
        for p in (*c.patterns, *c.unless_patterns):
            re.compile(p)
        out.append(c)
    return Taxonomy(tuple(out), float(raw.get("default_threshold", 0.8)), str(raw.get("version", "")))


def scoring(raw: dict | None = None) -> Scoring:
    raw = load_yaml(CONF / "scoring.yaml") if raw is None else raw
    take = {"lam": "lambda", "beta": "beta", "places": "round_places", "expose_composite": "expose_composite", "method": "prop_score_method", "gamma": "prop_score_gamma", "alpha": "alpha", "weights": "category_weights", "increments": "additive_increments", "families": "composite_families", "bands": "bands"}
    return Scoring(**{k: raw[v] for k, v in take.items() if v in raw})


def check_seed(pipeline: dict) -> int:
    """The engine uses no randomness; a run still has to state its seed."""
    seed = pipeline.get("seed")
    if not isinstance(seed, int) or isinstance(seed, bool) or not 0 <= seed < 1 << 32:
        raise ValueError(f"seed must be a whole number from 0 to 2**32 - 1: {seed!r}")
    return seed


@dataclass(frozen=True)
class Settings:
    taxonomy: Taxonomy
    scoring: Scoring
    pipeline: dict
    hashes: dict

    @staticmethod
    def load(folder: str | Path = CONF, taxonomy_file: str = "taxonomy.yaml", threshold: float | None = None) -> Settings:
        raw = {k: load_yaml(Path(folder) / v) for k, v in (("pipeline", "pipeline.yaml"), ("taxonomy", taxonomy_file), ("scoring", "scoring.yaml"))}
        check_seed(raw["pipeline"])
        made = taxonomy(raw["taxonomy"])
        if threshold is not None:
            made = Taxonomy(made.categories, threshold, made.version)
        return Settings(made, scoring(raw["scoring"]), raw["pipeline"], {f"{k}_hash": digest(v) for k, v in raw.items()})
