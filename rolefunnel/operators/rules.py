"""Rule lists, scoring weights and profile: small, driver-side, always arguments."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

# Words that negate a phrase following within the window.
NEGATION_WORDS = [
    "not",
    "no",
    "never",
    "without",
    "non",
    "dont",
    "doesnt",
    "didnt",
    "isnt",
    "arent",
    "wasnt",
    "werent",
    "wont",
    "cant",
    "cannot",
    "shouldnt",
    "neednt",
]
NEGATION_WINDOW = 5

# Phrases the contract guess looks for, strongest list first.
CONTRACT_PHRASES = {
    "b2b": ["b2b", "invoice", "registered company", "own company", "corp to corp", "c2c"],
    "freelance": [
        "freelance",
        "freelancer",
        "1099",
        "contractor",
        "contract role",
        "contract position",
        "freiberufler",
    ],
    "employment": [
        "full-time employment",
        "permanent position",
        "full time employee",
        "permanent role",
        "full time",
    ],
}

# The three word sets of a hiring-process disclosure sentence.
DISCLOSURE_WORDS = (
    r"artificial intelligence|ai",
    r"screen|assess|evaluat|review",
    r"applicant|application|candidate|resume|r[ée]sum[ée]|hiring process",
)

RANKING_MODES = ("heuristic", "ai")


def norm_phrase(text: str) -> str:
    """Driver-side twin of ``functions.text.normalize_text`` for rule literals."""
    spaced = re.sub(r"[-_/]", " ", (text or "").lower())
    return " ".join(re.sub(r"[^\w\s]", "", spaced).split())


@dataclass(frozen=True)
class Negation:
    words: tuple[str, ...] = tuple(NEGATION_WORDS)
    window: int = NEGATION_WINDOW


@dataclass(frozen=True)
class KeywordGroup:
    name: str
    weight: float
    phrases: tuple[str, ...]


def _from(section: str, key: str, default: object = ()):
    """A field that configuration sets: where it is found, and its value where it is not."""
    return field(default=default, metadata={"section": section, "key": key})


@dataclass(frozen=True)
class Rules:
    """Everything classification and scoring need to know."""

    exclude: tuple[str, ...] = _from("filters", "exclude_phrases")
    hybrid_onsite: tuple[str, ...] = _from("filters", "hybrid_onsite_phrases")
    remote_indicator: tuple[str, ...] = _from("filters", "remote_indicator_phrases")
    needs_review: tuple[str, ...] = _from("filters", "needs_review_phrases")
    positive: tuple[str, ...] = _from("filters", "positive_phrases")
    relevance: tuple[str, ...] = _from("filters", "relevance_keywords")
    relevance_weak: tuple[str, ...] = _from("filters", "relevance_keywords_weak")
    non_role_title: tuple[str, ...] = _from("filters", "non_role_title_phrases")
    keyword_groups: tuple[KeywordGroup, ...] = ()
    role_targets: tuple[str, ...] = _from("profile", "role_targets")
    core_skills: tuple[str, ...] = _from("profile", "core_skills")
    contract: dict[str, list[str]] = field(default_factory=lambda: CONTRACT_PHRASES)
    negation: Negation = Negation()
    disclosure: tuple[str, str, str] = DISCLOSURE_WORDS
    title_match_bonus: int = _from("ranker", "title_match_bonus", 15)
    positive_signal_bonus_cap: int = _from("ranker", "positive_signal_bonus_cap", 15)
    recency_bonus_max: int = _from("ranker", "recency_bonus_max", 10)
    near_miss_penalty: int = _from("ranker", "near_miss_penalty", 10)

    @property
    def max_score(self) -> float:
        return 40.0 + self.title_match_bonus + self.positive_signal_bonus_cap + self.recency_bonus_max


@dataclass(frozen=True)
class Settings:
    """Rules plus the switches of a run."""

    rules: Rules
    sources: dict[str, bool]
    ranking_mode: str = _from("", "ranking_mode", "heuristic")
    min_score_threshold: int = _from("", "min_score_threshold", 30)
    scan_interval_days: int = _from("github_lists", "scan_interval_days", 7)


def _configured(kind: type, sections: dict[str, dict]) -> dict[str, object]:
    """The fields of ``kind`` that the configuration sets, in the types of their defaults."""
    found = {}
    for f in fields(kind):
        value = sections.get(f.metadata.get("section"), {}).get(f.metadata.get("key"))
        if value is not None:
            found[f.name] = type(f.default)(value)
    return found


def settings_from(config: dict, profile: dict | None = None) -> Settings:
    """Build settings from parsed configuration and profile mappings; what they leave out has its default."""
    sections = {"": config, "profile": profile or {}} | {name: config.get(name) or {} for name in ("filters", "ranker", "github_lists")}
    groups = sections["ranker"].get("keyword_groups", {})
    weighted = tuple(KeywordGroup(name, float(g.get("weight", 1.0)), tuple(g.get("phrases", ()))) for name, g in groups.items())
    made = Settings(Rules(**_configured(Rules, sections), keyword_groups=weighted), dict(config.get("sources") or {}), **_configured(Settings, sections))
    if made.ranking_mode not in RANKING_MODES:
        raise ValueError(f"no such ranking mode: {made.ranking_mode!r}; there are {', '.join(RANKING_MODES)}")
    return made


def _flat(rules: Rules) -> Iterable[tuple[str, str, str, float, int]]:
    for f in fields(Rules):
        if isinstance(f.default, tuple) and f.metadata:
            for i, phrase in enumerate(getattr(rules, f.name)):
                yield f.metadata["key"], "", phrase, 0.0, i
    for group in rules.keyword_groups:
        for i, phrase in enumerate(group.phrases):
            yield "keyword_groups", group.name, phrase, group.weight, i


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The rules in long form: (list_name, group_name, phrase, phrase_norm, weight, ord)."""
    rows = [(a, b, c, norm_phrase(c), d, e) for a, b, c, d, e in _flat(rules)]
    ddl = "list_name string, group_name string, phrase string, phrase_norm string, weight double, ord int"
    return spark.createDataFrame(rows, ddl)
