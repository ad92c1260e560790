"""Forms of text for comparing wordings: what looks the same is one character, and case, accents, punctuation and blanks are gone."""

from __future__ import annotations

import re
import unicodedata

from pageloom.llm.lookalike import LETTER_CLASSES

ACCENTS = re.compile("[̀-ͯ]")
#: Scripts written without blanks: every character counts as a word of its own.
UNSPACED = "฀-๿぀-ヿ㐀-鿿豈-﫿"
WORD = re.compile(rf"[{UNSPACED}]|(?:[^\W_{UNSPACED}]|[̀-֑ͯ-ׇؐ-ٟऀ-ःऺ-ॏ])+")
ASCII_WORD = re.compile("[a-z0-9]+")
HYPHENS = ("-", "‐", "‑")
BROKEN = re.compile(r"(?<=\w)[-‐‑](?:[^\S\n]*\n\s*)?(?=\w)")


def _caseless() -> dict[int, str]:
    """Small letters to the letter they are when case is set aside: alike themselves, or alike as capitals (Cyrillic ka and k).

    Letters of one script stay apart: where a letter is like two (Greek nu, as a capital and as a small one), the capital counts.
    """
    same: dict[int, str] = {}
    for letters in sorted(LETTER_CLASSES, key=lambda x: not x[0].isupper()):
        first = letters[0].casefold()
        for other in letters[1:]:
            small = other.casefold()
            if len(small) == 1 and small != first and not small.isascii() and small != "μ":
                same.setdefault(ord(small), first)
    return same


CASELESS = _caseless()
ANY_CASELESS = re.compile("[μ" + "".join(map(chr, CASELESS)) + "]")
#: Mu is m inside Greek words only; elsewhere it is the sign of a unit.
MU_IN_WORD = re.compile("μ(?=[α-ω])|(?<=[α-ω])μ")


def fold(text: str) -> str:
    """Lower case without accents, letters that look alike in either case as one; other marks (vowel signs, voicing) stay."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFC", ACCENTS.sub("", unicodedata.normalize("NFKD", text))).casefold()
    if not ANY_CASELESS.search(plain):
        return plain
    return (MU_IN_WORD.sub("m", plain) if "μ" in plain else plain).translate(CASELESS)


def words_of(text: str) -> list[str]:
    """Folded words of a text; hyphens inside words, and the line breaks after them, are closed up."""
    if any(x in text for x in HYPHENS):
        text = BROKEN.sub("", text)
    return ASCII_WORD.findall(text.lower()) if text.isascii() else WORD.findall(fold(text))


def letters_of(text: str) -> str:
    """All folded letters and digits in a row."""
    return letters_in(fold(text))


def letters_in(folded: str) -> str:
    """All letters and digits of a folded text in a row."""
    return "".join((ASCII_WORD if folded.isascii() else WORD).findall(folded))


def digits_of(letters: str) -> str:
    """The decimal digits of a folded text, in order, as ASCII."""
    if letters.isascii():
        return "".join(filter(str.isdigit, letters))
    return "".join(str(unicodedata.digit(x)) for x in letters if x.isdecimal())


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring letters exchanged as one edit; ``most + 1`` where it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    older: dict[int, int] = {}
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):  # only the band of width most around the diagonal can matter
        older, before, row = before, row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[0] = i
                continue
            cost = min(before.get(j, far) + 1, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, older.get(j - 2, far) + 1)
            row[j] = cost
        if min(row.values()) > most:
            return far
    return min(row.get(len(b), far), far)
