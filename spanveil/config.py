"""Types, priorities and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: The kinds of personal data and their priority; the lower one wins an overlap.
PRIORITY = {
    "EMAIL": 10, "URL": 15, "CREDIT_CARD": 20, "SSN": 25, "IP_ADDRESS": 30, "NATIONAL_ID": 35,
    "PHONE": 40, "DOB": 50, "ADDRESS": 60, "ORGANIZATION": 70, "PERSON": 80,
}
REQUIRED = ("PERSON", "EMAIL", "PHONE", "ORGANIZATION", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP_ADDRESS")
EXTENDED = ("NATIONAL_ID", "URL")
#: Kinds whose entities are looked for again everywhere in the document.
SWEPT = ("PERSON", "ORGANIZATION", "EMAIL", "PHONE", "NATIONAL_ID", "URL", "ADDRESS")
SPAN = "struct<start:int,end:int,text:string,pii_type:string,detector:string,confidence:double>"


@dataclass(frozen=True)
class Config:
    types: tuple[str, ...] = REQUIRED + EXTENDED
    seed: int = 20260925
    min_confidence: float = 0.60
    sweep: bool = True
    dob_mode: str = "labelled"  # or "contextual"
    disabled: tuple[str, ...] = field(default_factory=tuple)
    current_year: int = 2026
    #: Scope of the entity dictionary: one document, or the whole corpus.
    scope: str = "doc_id"

    def with_types(self, *types: str) -> Config:
        unknown = set(types) - set(PRIORITY)
        if unknown:
            raise ValueError(f"unknown types: {sorted(unknown)}")
        return replace(self, types=types)

    def without(self, *detectors: str) -> Config:
        return replace(self, disabled=(*self.disabled, *detectors))


def parse_types(text: str) -> tuple[str, ...]:
    """A comma list of kinds; ``all`` and ``default`` mean every one."""
    if text.strip().lower() in ("all", "default", ""):
        return REQUIRED + EXTENDED
    return Config().with_types(*[x.strip().upper() for x in text.split(",") if x.strip()]).types


DEFAULT = Config()
NO_SWEEP = replace(DEFAULT, sweep=False)
