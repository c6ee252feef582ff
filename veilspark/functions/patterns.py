"""Detection patterns. Every one is read with Unicode classes, as `(?U)`.

The pattern strings, word lists and confidences below are fixed values: results
depend on them as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
UPPER = "A-ZÀÂÄÉÈÊËÏÎÔÙÛÜ"
LOWER = "a-zàâäéèêëïîôöùûü"
NOT_BEFORE_FIRST_NAME = (
    "Cabinet|Société|Association|Fondation|Institut|Groupe|Consortium|Fédération|Entreprise|Compagnie|Direction|Service|Département"
    "|Commission|Comité|Syndicat|Chambre|Mutuelle|Coopérative|Ordre|Caisse|Union|Confédération|Agence|Ligue"
)
ORG_FORMS = (
    "SA|SARL|SAS|SASU|EURL|SNC|SCM|SCI|GIE|EI|SCOP|SEL|Association|Fondation|Institut|Groupe|Consortium|Fédération|Syndicat|Chambre"
    "|Mutuelle|Coopérative|Ordre|Caisse|Union|Confédération|Agence|Comité|Commission|Ligue"
)
ORG_KEYWORDS = (
    "Société|Entreprise|Cabinet|Groupe|Compagnie|Association|Fondation|Institut|Consortium|Fédération|Syndicat|Chambre|Mutuelle"
    "|Coopérative|Ordre|Caisse|Union|Confédération|Agence|Comité|Commission|Ligue"
)
TITLE = r"\b(?:Docteur|Professeur|Madame|Monsieur|Mademoiselle|Maître|Dr\.?|Pr\.?|Prof\.?|M\.?|Mme\.?|Mlle\.?|Me\.?)(?!\w)\s*"
PREPOSITION = r"^[\s]*(?:(?:d'|l')|(?:aux|au|des|du|de|à|en)\s+)"
LABEL_WORDS = ("lieu", "date", "heure", "objet", "sujet", "titre", "nom", "adresse")
ORG_OVER_PERSON = ("Cabinet", "Société", "Entreprise", "Groupe", "Compagnie")
ENTITY_TYPES = ("PERSON", "LOCATION", "ORG")
LABELS = {"PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION", "ORG": "ORG"}

_NAME = rf"[{UPPER}][{LOWER}]+"


@dataclass(frozen=True)
class Pattern:
    name: str
    entity_type: str
    confidence: float
    regex: str
    enabled: bool = True
    #: What a match's characters are, and what it must end in: a long text without such an end is then not searched from each capital on.
    within: str | None = None
    ending: str | None = None


# Fixed values.
PATTERNS = (
    Pattern("titles", "PERSON", 0.85, rf"\b(M\.|Mme|Mlle|Dr\.|Pr\.|Maître|Me\.?)\s+({_NAME}(?:\s+{_NAME})?)"),
    Pattern("compound_names", "PERSON", 0.80, rf"\b({_NAME}-{_NAME})\b"),
    Pattern("last_first_names", "PERSON", 0.80, rf"\b({_NAME}(?:-{_NAME})?)\s*,\s*(?!{NOT_BEFORE_FIRST_NAME})({_NAME}(?:-{_NAME})?)"),
    Pattern("location_indicators", "LOCATION", 0.65, rf"\b(à|en|dans|près de|ville de)\s+({_NAME}(?:\s+{_NAME})?)"),
    Pattern("organizations_suffix", "ORG", 0.70, rf"\b([{UPPER}][A-Za-zàâäéèêëïîôöùûü\s&,'.\-]+?)\s+({ORG_FORMS})\b", True, rf"[{UPPER}A-Za-zàâäéèêëïîôöùûü\s&,'.\-]+", rf"\s({ORG_FORMS})\b"),
    Pattern("organizations_prefix", "ORG", 0.70, rf"\b({ORG_KEYWORDS})\s+([{UPPER}][A-Za-zàâäéèêëïîôöùûü\s&,\-]+)"),
)
FULL_NAME = Pattern("full_names", "PERSON", 0.65, rf"\b({_NAME}(?:-{_NAME})?)\s+({_NAME})")
GEOGRAPHY = Pattern(
    "geography_dictionary",
    "LOCATION",
    0.60,
    rf"\b([{UPPER}][{LOWER}]*(?:[-'][A-Za-zàâäéèêëïîôöùûü]+)*(?:\s+(?:de|du|des|d'|en|et|la|le|les|sur)\s+"
    rf"[{UPPER}{LOWER}][{LOWER}]*(?:[-'][A-Za-zàâäéèêëïîôöùûü]+)*)*)",
)

# The patterns of the corpus annotator.
ANNOTATOR = (
    Pattern("a_title_name", "PERSON", 1.0, r"(?:Dr\.|Pr\.|M\.|Mme|Me|Professeur|Docteur)\s+[A-ZÀ-ÖØ-öø-ÿ][a-zà-öø-ÿ\-]+(?:\s+[A-ZÀ-ÖØ-öø-ÿ][a-zà-öø-ÿ\-]+)+"),
    Pattern("a_full_name", "PERSON", 1.0, r"\b[A-ZÀ-ÖØ-öø-ÿ][a-zà-öø-ÿ]{2,}(?:\-[A-ZÀ-ÖØ-öø-ÿ][a-zà-öø-ÿ]{2,})?\s+[A-ZÀ-ÖØ-öø-ÿ][a-zà-öø-ÿ]{2,}\b"),
    Pattern("a_technology", "ORG", 1.0, r"\b(?:Microsoft|Google|IBM|Amazon|Apple|Oracle|Salesforce|SAP|Huawei|Cisco)(?:\s+(?:France|Europe|Cloud|Corporation))?\b"),
    Pattern("a_institution", "ORG", 1.0, r"\b(?:Université|École|Institut|INRIA)\s+[A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ\-\s]+\b"),
    Pattern("a_legal_form", "ORG", 1.0, r"\b[A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ]{2,}\s+(?:SA|SAS|SARL|Corp|Corporation|Group|Industries)\b"),
    Pattern("a_finance", "ORG", 1.0, r"\b[A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ]+\s+(?:Banque|Bank|Crédit|Assurance)\b"),
    Pattern("a_city", "LOCATION", 1.0, r"\b(?:Paris|Lyon|Marseille|Toulouse|Nice|Nantes|Strasbourg|Montpellier|Bordeaux|Lille|Rennes|Défense)\b"),
    Pattern("a_country", "LOCATION", 1.0, r"\b(?:France|Allemagne|Italie|Espagne|Belgique|Suisse|Luxembourg)\b"),
    Pattern("a_city_abroad", "LOCATION", 1.0, r"\b(?:Londres|Berlin|Madrid|Rome|Brussels|Geneva|Zurich)\b"),
)


def load_patterns(path: str) -> tuple[Pattern, ...]:
    """Enabled patterns of a YAML file (category: enabled, confidence, entity_type, patterns: [pattern]).

    A pattern that doesn't compile is left out with a warning; categories without patterns are dictionaries.
    """
    import re
    import warnings

    import yaml

    with open(path, encoding="utf-8") as file:
        found = (yaml.safe_load(file) or {}).get("patterns") or {}
    out = []
    for name, category in found.items():
        for k, entry in enumerate(category.get("patterns") or () if category.get("enabled", True) else ()):
            regex = entry["pattern"] if isinstance(entry, dict) else entry
            try:
                re.compile(regex)
            except re.error as error:
                warnings.warn(f"pattern {name}/{k} is left out: {error}", stacklevel=2)
                continue
            out.append(Pattern(f"{name}_{k}" if k else name, category["entity_type"], float(category.get("confidence", 0.5)), regex))
    return tuple(out)
