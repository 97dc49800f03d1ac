"""Names of people beside offices, labels and titles, found in one text.

Plain Python without a session: Arrow workers import this module."""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanveil.functions import lexicons as L

TOKEN = r"(?:[^\W\d_a-z]\.|[^\W\d_a-z][^\W\d_]+(?:['’\-][^\W\d_]+)*)"
PARTICLES = "|".join(L.NAME_PARTICLES)
NAME = re.compile(rf"{TOKEN}(?:\s+(?:(?:{PARTICLES})\s+)?{TOKEN})*")


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


#: A label, and what follows it up to the end of its field.
LABELLED = re.compile(rf"(?<!\w)(?:{_any(L.PERSON_CUES)})\s*[:|–-]\s*([^|;\n]{{2,160}})", re.I)
SEPARATOR = re.compile(r"\s*(?:[/,&]|\band\b)\s*")
OFFICE = re.compile(rf"\s*[,|]?\s+(?:{_any(L.PERSON_CUES)})\b")
TITLED = re.compile(rf"(?<![\w.])(?:{_any(L.HONORIFICS)})\s+(?=\w)", re.I)
#: Most words of a name, and how far a programme's title is looked for.
LONGEST, REACH = 5, 36
NOT_NAMES = frozenset({*L.ADDRESS_WORDS, *L.DESIGNATIONS, *L.NON_PERSON_TOKENS, *L.PUBLIC_TOKENS, *L.LOCALITIES, *(s.lower() for s in L.ORG_SUFFIXES)})
NOT_WHOLE = frozenset({*L.PUBLIC_BODIES, *L.STATES, *L.ROLE_PHRASES})


def is_person(name: str, single: bool = False) -> bool:
    """Two to five capitalised words (or one), none of which speaks for something else."""
    words = name.split()
    low = [w.lower().rstrip(".,") for w in words]
    return (
        (1 if single else 2) <= len(words) <= LONGEST
        and not any(c.isdigit() for c in name)
        and not any(w in NOT_NAMES for w in low)
        and " ".join(low) not in NOT_WHOLE
        and not all(w in L.GENERIC_WORDS for w in low)
        and any(len(w) > 1 for w in low)
        and all(w[0].isupper() or w.lower() in L.NAME_PARTICLES for w in words)
    )


def bare(name: str) -> str:
    """Without the labels of the next field at its end."""
    words = list(re.finditer(r"\S+", name))
    while words and words[-1].group().lower().strip(".,;:") in L.FIELD_LABELS:
        words.pop()
    return name[: words[-1].end()].rstrip(" .,") if words else ""


def in_scheme(text: str, start: int, end: int) -> bool:
    """Whether the words after a name, or from its third on, make it the title of a programme."""
    words = text[start:end].split()[2:] + text[end : end + REACH].split()
    return any(w.lower().strip(",.;:()") in L.SCHEME_WORDS for w in words)


def parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The pieces of a list: ``A B/ C D and E F``."""
    for m in SEPARATOR.finditer(text, start, end):
        yield start, m.start()
        start = m.end()
    yield start, end


#: Every text with a name that :func:`people` finds has one of these words.
CUE_WORDS = tuple(sorted({w.split()[-1].lower().strip(".") for w in (*L.PERSON_CUES, *L.HONORIFICS)}))


def candidates(text: str) -> Iterator[tuple[int, str, float, bool]]:
    """(start, name, confidence, whether one word will do), the surest first."""
    for m in LABELLED.finditer(text):
        for start, end in parts(text, *m.span(1)):
            start += len(text[start:end]) - len(text[start:end].lstrip())
            if found := NAME.match(text, start, end):
                yield start, bare(found.group()), 0.98, False
    for m in TITLED.finditer(text):
        if found := NAME.match(text, m.end()):
            yield m.end(), bare(found.group()), 0.95, True
    for m in NAME.finditer(text):
        words = list(re.finditer(r"\S+", m.group()))
        # an office may be part of the run of capitalised words: the name ends before it
        for k in range(len(words), 1, -1):
            end = m.start() + words[k - 1].end()
            if OFFICE.match(text, end):
                first = max(0, k - LONGEST)
                yield m.start() + words[first].start(), m.group()[words[first].start() : words[k - 1].end()], 0.95, False


def people(text: str) -> list[tuple[int, int, str, float]]:
    out: list[tuple[int, int, str, float]] = []
    for start, name, confidence, single in candidates(text):
        if single:  # a title stands before five words at most
            words = list(re.finditer(r"\S+", name))[:LONGEST]
            name = name[: words[-1].end()].rstrip(" .,") if words else ""
        end = start + len(name)
        if not name or not is_person(name, single) or in_scheme(text, start, end):
            continue
        if not any(s <= start and end <= e for s, e, _, _ in out):
            out.append((start, end, name, confidence))
    return sorted(out)


def listed(text: str) -> list[tuple[int, int, str, float]]:
    """The names of a cell in a column of names."""
    stripped = text.strip()
    if not 0 < len(stripped) <= 80:
        return []
    first = text.index(stripped)
    spots = parts(text, first, first + len(stripped)) if "/" in stripped else [(first, first + len(stripped))]
    return [(s, e, text[s:e], 1.0) for s, e in spots if is_person(text[s:e]) and not in_scheme(text, s, e)]
