"""Thresholds, weights and dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Thresholds:
    """Prioritisation limits. Fixed values."""

    minimum_reports: int = 3
    ror_lower_ci: float = 1.0
    prr: float = 2.0
    chi_square: float = 4.0
    baseline_quarters: int = 4
    high_priority: float = 0.75
    moderate_priority: float = 0.50
    small_n: int = 30
    very_small_n: int = 10


@dataclass(frozen=True)
class Weights:
    """Shares of the composite priority; they sum to 1. Fixed values."""

    disproportionality: float = 0.30
    trend_anomaly: float = 0.25
    seriousness: float = 0.20
    literature_support: float = 0.15
    population_context: float = 0.10

    def __post_init__(self):
        total = self.disproportionality + self.trend_anomaly + self.seriousness + self.literature_support + self.population_context
        if abs(total - 1) > 1e-9:
            raise ValueError(f"weights sum to {total}, not 1")


@dataclass(frozen=True)
class Domain:
    """A curated dictionary: canonical name -> (class, aliases)."""

    names: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    def aliases(self) -> dict[str, str]:
        return {a.upper(): name for name, (_, aliases) in self.names.items() for a in (name, *aliases)}

    def classes(self) -> dict[str, str]:
        return {name: c for name, (c, _) in self.names.items()}


#: The curated domain. Fixed values.
CURATED = Domain(
    {
        "semaglutide": ("GLP-1 receptor agonists", ("OZEMPIC", "WEGOVY", "RYBELSUS")),
        "liraglutide": ("GLP-1 receptor agonists", ("VICTOZA", "SAXENDA")),
        "dulaglutide": ("GLP-1 receptor agonists", ("TRULICITY",)),
        "exenatide": ("GLP-1 receptor agonists", ("BYETTA", "BYDUREON")),
        "tirzepatide": ("Dual GIP/GLP-1 receptor agonists", ("MOUNJARO", "ZEPBOUND")),
        "sitagliptin": ("DPP-4 inhibitors", ("JANUVIA",)),
        "linagliptin": ("DPP-4 inhibitors", ("TRADJENTA",)),
        "empagliflozin": ("SGLT2 inhibitors", ("JARDIANCE",)),
        "dapagliflozin": ("SGLT2 inhibitors", ("FARXIGA",)),
        "metformin": ("Biguanides", ("GLUCOPHAGE", "FORTAMET")),
    }
)

#: Terms that mark an adverse context in an article. Fixed values.
ADVERSE_TERMS = ("adverse", "safety", "side effect", "toxicity", "risk", "pharmacovigilance", "case report")

#: Label sections, most severe first. Fixed values.
LABEL_SECTIONS = ("boxed_warning", "contraindications", "warnings_and_cautions", "warnings", "adverse_reactions", "precautions")

#: Roles under which an item counts as suspect. Fixed values.
SUSPECT_ROLES = ("PS", "SS", "I")


# -- from files ----------------------------------------------------------------------------------


def read_yaml(path: str, spark=None) -> dict:
    """A YAML file of settings; with a session from any of Hadoop's file systems."""
    import yaml

    if spark is None:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    return yaml.safe_load("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())) or {}  # one file


def _numbers(cls, given: dict):
    known = {f.name for f in fields(cls)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {unknown}")
    return cls(**given)


def domain_from(settings: dict) -> Domain:
    """`drugs`: canonical name -> class and aliases."""
    return Domain({str(name).lower(): (d.get("class", ""), tuple(str(a).upper() for a in d.get("aliases") or ())) for name, d in (settings.get("drugs") or {}).items()})


def thresholds_from(settings: dict) -> Thresholds:
    return _numbers(Thresholds, settings.get("thresholds") or {})


def weights_from(settings: dict) -> Weights:
    """Weights that do not sum to 1 raise an error."""
    return _numbers(Weights, settings.get("weights") or {})


def quarters_from(settings: dict) -> list[tuple[int, int]]:
    """`quarters`: labels and ranges like 2012q4..2013q2, each quarter once, sorted."""
    from caselens.functions.dates import expand_quarters

    return expand_quarters([str(q) for q in settings.get("quarters") or ()])


def survey_columns_from(settings: dict) -> dict[str, str]:
    """`survey`: what a column means -> its name in the survey's files."""
    return {str(k): str(v) for k, v in (settings.get("survey") or {}).items()}


def literature_terms_from(settings: dict) -> tuple[str, ...]:
    """`literature_terms`: what marks an adverse context; the fixed terms where none are given."""
    return tuple(str(t).lower() for t in settings.get("literature_terms") or ADVERSE_TERMS)
