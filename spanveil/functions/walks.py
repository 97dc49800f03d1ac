"""Token walks that find organisations and addresses in one text.

Plain Python without a session: Arrow workers import this module."""

from __future__ import annotations

import re

import pandas as pd

from spanveil.functions import lexicons as L

SUFFIX = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(s) for s in sorted({x for s in L.ORG_SUFFIXES for x in (s, s.upper())}, key=lambda s: (-len(s), s))) + r")(?!\w)")
PUBLIC = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(s) for s in L.PUBLIC_BODIES if len(s) >= 8) + r")(?!\w)", re.I)
TOKEN = re.compile(r"\S+")
CONNECTIVES = {"and", "&", "of", "for", "the"}
LEGAL = {s.lower().strip(".") for s in L.LEGAL_FORMS}
SUFFIX_WORDS = {w.lower().strip(".") for s in L.ORG_SUFFIXES for w in s.split()}
OF_TAIL = re.compile(r"\s+of\s+(?:the\s+)?[A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+)*")
OF_HEADS = {"bank", "institute", "university", "house", "council", "society"}
#: Words that a name reaches to the left, and the confidences of spans.
LEFT_TOKENS = 8
ORG_CONFIDENCE = 0.97
LABELLED_ADDRESS, BARE_ADDRESS = 0.95, 0.88


def plain(word: str) -> str:
    return word.lower().strip(".,;:()&'’\"“”[]")


def is_public_or_role(name: str) -> bool:
    n = " ".join(name.lower().split()).strip(" .,;:")
    n2 = re.sub(r"^(?:the|our|an?)\s+", "", n)
    return any(x in L.PUBLIC_BODIES or x in L.ROLE_PHRASES or x in L.PUBLIC_TOKENS for x in (n, n2))


def telling(word: str) -> bool:
    """Whether a word says which firm is meant."""
    w = plain(word)
    return len(w) > 1 and w not in L.GENERIC_WORDS and w not in CONNECTIVES and w not in SUFFIX_WORDS and w not in L.DESIGNATIONS and w not in L.PUBLIC_TOKENS


def looks_like_org(name: str) -> bool:
    """At least two words, and a telling one left of the suffix."""
    words = name.split()
    if len(name) < 4 or len(words) < 2 or is_public_or_role(name):
        return False
    last = max((m.start() for m in SUFFIX.finditer(name)), default=len(name))
    return any(telling(w) for w in name[:last].split())


def without_role(name: str) -> str:
    """The name without what stands before it: parts in a contract, generic words,
    connectives.  Taking one away can bring up another, so it goes on until none is left."""
    words = name.split()
    while len(words) > 1:
        role = next((k for k in range(min(len(words) - 1, 6), 0, -1) if " ".join(words[:k]).lower() in L.ROLE_PHRASES), 0)
        if role:
            words = words[role:]
        elif plain(words[0]) in CONNECTIVES or plain(words[0]) in L.GENERIC_WORDS and len(words) > 2 and looks_like_org(" ".join(words[1:])):
            words = words[1:]
        else:
            break
    return " ".join(words)


def left_edge(text: str, suffix: int) -> int:
    """Where the name before a suffix begins."""
    start = suffix
    tokens = list(TOKEN.finditer(text, max(0, suffix - 200), suffix))[-LEFT_TOKENS:]
    for i in range(len(tokens) - 1, -1, -1):
        word, low = tokens[i].group(), plain(tokens[i].group())
        before = plain(tokens[i - 1].group()) if i else ""
        if re.search(r"[,;:–—|”\"]", word.lstrip("“\"'([")) or word == "-":
            break
        if low in CONNECTIVES or word == "&":
            # "and" after a legal form begins another firm; "of" belongs to few names
            if low == "and" and before in LEGAL or low == "of" and before not in OF_HEADS:
                break
            continue
        if low in LEGAL or low in L.LEFT_STOPS or low in L.OFFICES or not re.match(r"[(\"“]?[^\W_a-z]", word):
            break
        if word.endswith(".") and len(word) > 3:
            break
        start = tokens[i].start()
    return start


def organizations(text: str) -> list[tuple[int, int, str, float]]:
    veto = [m.span() for m in PUBLIC.finditer(text)]
    out: list[tuple[int, int, str, float]] = []
    for m in SUFFIX.finditer(text):
        if plain(m.group()) in {plain(w) for w in L.WEAK_SUFFIXES}:
            after = re.match(r"\s*([A-Za-z]+)", text[m.end() : m.end() + 40])
            left = [w for w in text[max(0, m.start() - 80) : m.start()].split() if plain(w) not in CONNECTIVES and w != "&"]
            if after and after.group(1).lower() in L.AFTER_WEAK or not left or not left[-1][:1].isupper() or plain(left[-1]) in L.GENERIC_WORDS:
                continue
        start, end = left_edge(text, m.start()), m.end()
        if tail := OF_TAIL.match(text, end):
            end = tail.end()
        lead = re.match(r"[(\"“\s]+", text[start:end])
        start += lead.end() if lead else 0
        words = text[start:end].split()
        kept = without_role(" ".join(words)).split()
        start = list(TOKEN.finditer(text, start, end))[len(words) - len(kept)].start() if kept else start
        name = text[start:end]
        if looks_like_org(" ".join(kept)) and not any(s < end and start < e for s, e in veto):
            if out and out[-1][0] <= start and out[-1][1] >= end:
                continue
            if out and start <= out[-1][0] and end >= out[-1][1]:
                out.pop()
            out.append((start, end, name, ORG_CONFIDENCE))
    return out


PIN = re.compile(r"(?<![\w-])\d{3} ?\d{3}(?![\w-])")
ZIP = re.compile(r"\b[A-Z]{2} \d{5}(?:-\d{4})?(?!\w)")
#: What ends the search to the left of a code: a break, a label, a preposition, a sentence.
BOUNDARY = re.compile(
    r"\n|;|:\s+|(?<=[a-z]{3})\.\s+(?=[A-Z])|\b(?:located|situated|residing|having its office|premises)\s+(?:at|in)\s+|\bat\s+(?=[A-Z0-9])"
    r"|\b(?:registered|corporate|head|branch|residential|correspondence)?\s*(?:office|address)\s*(?:is)?\s*[:\-]?\s+",
    re.I,
)
#: A firm's legal form ends its name, and its address follows; a landmark's does not.
FIRM_END = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(s) for s in sorted(L.LEGAL_FORMS, key=lambda s: (-len(s), s))) + r")[\s,]+")
LANDMARK = re.compile(r"\b(?:opp(?:osite)?|near|behind|next to|beside|above|adjacent to)\b[^,;\n]*$", re.I)
HOUSE = re.compile(r"\b(?:no\.?\s*)?\d+[A-Za-z]?\b")
PLACE = re.compile(r"(?:[-–,]\s*|\b(?:" + "|".join(L.LOCALITIES) + r")\s*)$", re.I)
LOCALITY = re.compile(r"(?:" + "|".join(L.LOCALITIES) + r")\s*[-–]\s*$", re.I)
#: How far an address reaches to the left, and its least length; a locality and
#: its code alone are an address from nine characters on.
REACH, FLOOR, SHORT = 260, 18, 9
COUNTRIES = ("india", "usa", "united states", "united kingdom", "uk", "singapore", "germany", "france")


def address_evidence(text: str) -> bool:
    words = {w.lower().strip(".,") for w in re.split(r"[\s,]+", text)}
    house, comma = bool(HOUSE.search(re.sub(PIN, "", text))), "," in text
    place, state = words & set(L.LOCALITIES), any(s in text.lower() for s in L.STATES)
    return bool(words & set(L.ADDRESS_WORDS)) or bool(place and (house or comma)) or bool(state and house)


def left_of(text: str, code: int) -> int:
    """Where the address before a code begins."""
    low = max(0, code - REACH)
    starts = [low, *(b.end() for b in BOUNDARY.finditer(text, low, code))]
    starts += [b.end() for b in FIRM_END.finditer(text, low, code) if not LANDMARK.search(text, low, b.start())]
    start = max(starts)
    lead = re.match(r"(?:(?:the|and|at|our|is|in|of)\b|[\s,.:;\-–(])+", text[start:code], re.I)
    return start + (lead.end() if lead else 0)


def with_tail(text: str, end: int) -> int:
    """The end of the states and countries that follow a code."""
    while m := re.compile(r"[\s,.\-–]+((?:[A-Z][\w]*)(?:\s(?:and\s)?[A-Z]\w*){0,4})").match(text, end):
        words = m.group(1).split()
        names = [" ".join(words[:k]) for k in range(len(words), 0, -1)]
        found = next((n for n in names if n.lower() in (*L.STATES, *L.LOCALITIES, *COUNTRIES)), "")
        if not found:
            break
        end = m.start(1) + len(found)
    return end


def addresses(text: str) -> list[tuple[int, int, str, float]]:
    found: list[tuple[int, int, str, float]] = []
    codes = [m for m in PIN.finditer(text) if PLACE.search(text[max(0, m.start() - 24) : m.start()])]
    for m in sorted([*codes, *ZIP.finditer(text)], key=lambda m: m.start()):
        start, end = left_of(text, m.start()), with_tail(text, m.end())
        value = text[start:end]
        short = len(value) >= SHORT and LOCALITY.match(text[start : m.start()])
        if not short and (len(value) < FLOOR or not address_evidence(value)):
            continue
        labelled = re.search(r"address|office", text[max(0, start - 60) : start], re.I)
        found.append((start, end, value, LABELLED_ADDRESS if labelled else BARE_ADDRESS))
    out: list[tuple[int, int, str, float]] = []
    for a in sorted(found, key=lambda a: (a[0] - a[1], a[0])):  # of two that overlap the wider one
        if not any(s < a[1] and a[0] < e for s, e, _, _ in out):
            out.append(a)
    return sorted(out)


def spans_of(texts: pd.Series, find, kind: str, name: str) -> pd.Series:
    """A list of spans for each text; none for a null one."""
    return texts.map(lambda t: [dict(start=s, end=e, text=v, pii_type=kind, detector=name, confidence=c) for s, e, v, c in find(t)] if t else [])
