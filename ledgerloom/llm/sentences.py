"""Sentences and words of narrative texts; headings, cue numbers, times and speakers are no sentences."""

from __future__ import annotations

import re

# Function words by which the language of a text is told; fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in at on was for with that by from had as his her it not but until under",
    "de": "der die das und um am ist mit von zu im den nicht für auf ein eine kam war nur dem",
    "fr": "le la les et de des du un une que ne pas à avec pour dans vers qu est au",
    "es": "el la los las de del un una y que en con por para se al lo a era sin",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_MARKS = [frozenset(v.split()) for v in FUNCTION_WORDS.values()]

# UTF-8 read as a one-byte encoding: a lead character and the characters that cp1252 has for 0x80-0xBF
_GARBLED = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+")
_INVISIBLE = re.compile("[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f­​-‏‪-‮⁠-⁩﻿]")
_CUE = re.compile(r"^\s*(?:\d+|[\d:.,\s]+-->[\d:.,\s]+)\s*$")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")
_BULLET = re.compile(r"^\s*[-*+•]\s+")
_SPEAKER = re.compile("^(?:\\[\\d[\\d:.,]*\\]\\s*)?(?:[^\\W\\d_][\\w'’-]*\\s+[—–]\\s+|[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’ -]*:\\s+)?")
# the end of a sentence: before white space and a capital, or, where a line end has been lost, right before one
_END = re.compile("[.!?…][\"'”’»)]*(?:\\s+(?=[\"'“‘«¿¡(]*[^\\Wa-zß-öø-ÿ])|(?=\\[\\d|[^\\W\\d_a-zß-öø-ÿ]))")
_ORDINAL = re.compile(r"\b(?:am|vom|zum|beim|der|die|das|den|dem|des|im)\s+\d{1,4}\.$", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
_ASCII_WORD = re.compile("[a-z]{2,}")


def _one_byte(s: str) -> bytes | None:
    out = bytearray()
    for ch in s:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return None
            out.append(ord(ch))
    return bytes(out)


def _repaired(m: re.Match) -> str:
    b = _one_byte(m.group())
    try:
        return b.decode("utf-8") if b else m.group()
    except UnicodeDecodeError:
        return m.group()


def _cut(line: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(line):
        end = m.end()
        s = line[at:end]
        # "am 3. Tag": a full stop after a number may mark an ordinal
        if line[m.start() - 1 : m.start()].isdigit() and _ORDINAL.search(s.rstrip()):
            continue
        out.append(s)
        at = end
    if at < len(line):
        out.append(line[at:])
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; garbled encodings are repaired, hard-wrapped scans joined again."""
    if not text:
        return []
    if not text.isascii() and any(c in text for c in "ÂÃâ"):
        text = _GARBLED.sub(_repaired, text)
    if not text.replace("\n", "").isprintable():
        text = _INVISIBLE.sub("", text)
    lines = text.splitlines()
    if len(lines) > 1:
        width = len(lines[0])
        if width >= 20 and len(lines[-1]) <= width and all(len(x) == width for x in lines[1:-1]):
            lines = ["".join(lines)]
    out = []
    for line in lines:
        line = line.strip()
        if not line:
            continue
        c = line[0]
        if c == "#" and _HEADING.match(line) or c.isdigit() and _CUE.match(line):
            continue
        if c in "-*+•":
            line = _BULLET.sub("", line)
        for s in _cut(line):
            head = s[:40]
            if "—" in head or "–" in head or ":" in head:
                s = _SPEAKER.sub("", s, count=1)
            if s:
                out.append(s)
    return out


def words(sentence: str) -> list[str]:
    """Lower-case words of at least two letters; none for salutations, signatures and other scraps."""
    low = sentence.lower()
    found = (_ASCII_WORD if low.isascii() else _WORD).findall(low)
    return found if len(found) > 3 or sentence.rstrip()[-1:] in set(".!?…\"”»") else []


def language(found: list[list[str]]) -> int:
    """Index in LANGUAGES of the language most of whose function words a text has."""
    distinct = set().union(*found)
    hits = [len(m & distinct) / len(m) for m in _MARKS]
    best = max(range(len(hits)), key=hits.__getitem__)
    return best if hits[best] else len(_MARKS)
