"""Script detection and a learned dictionary from Indic tokens to Latin ones."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from kindred.functions.lexicon import without_accents

FIRST, LAST = 0x0900, 0x0DFF
#: Nine scripts in blocks of 128 code points each, in code point order.
SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]")


def is_indic(text: str) -> bool:
    return any(FIRST <= ord(ch) < FIRST + 128 * 10 for ch in text)


def script_of(token: str) -> str | None:
    """The script of the first character that belongs to one of SCRIPTS."""
    for ch in token:
        block = (ord(ch) - FIRST) // 128
        if 0 <= block < len(SCRIPTS):
            return SCRIPTS[block]
    return None


def script_class(text: str) -> int:
    """0 other letters alone, 1 Indic letters alone, 2 both."""
    kinds = {FIRST <= ord(ch) <= LAST for ch in text if ch.isalpha()}
    return 2 if len(kinds) == 2 else int(True in kinds)


def bare(token: str) -> str:
    """A token without ASCII punctuation; marks of its script stay."""
    return _PUNCT.sub("", token).strip()


def skeleton(word: str) -> str:
    """Consonants, runs of one letter as one."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[aeiou]", "", word.lower()))


#: Letters that Unicode's names double for length or for the place of the tongue.
_DOUBLED = {"AA": "A", "II": "I", "UU": "U", "EE": "E", "OO": "O", "TT": "T", "DD": "D", "NN": "N", "SS": "SH", "LL": "L", "RR": "R"}


def romanise(token: str) -> str:
    """A Latin reading of a token in any of SCRIPTS, by the names that Unicode gives its characters.

    A consonant has an a behind it unless a vowel sign or a virama follows; long vowels are written short; the a at the
    end of a word of several consonants is not spoken.  Characters without a reading are left out.

    >>> romanise("कमल"), romanise("பிரகாஷ்"), romanise("ভারত")
    ('kamal', 'pirakash', 'bharat')
    """
    out: list[str] = []
    open_ = False  # whether the last sound is a consonant whose a is not yet settled
    for ch in unicodedata.normalize("NFC", token):
        script, _, rest = unicodedata.name(ch, "").partition(" ")
        if script not in SCRIPTS:
            if open_:
                out.append("a")
            open_ = False
            if ch.isascii() and ch.isalnum():
                out.append(ch.lower())
            continue
        kind, _, sound = rest.rpartition(" ")
        for long, short in _DOUBLED.items():
            sound = sound.replace(long, short)
        sound = sound.lower()
        if kind in ("SIGN", ""):
            if sound == "virama":
                open_ = False
            elif sound in ("anusvara", "candrabindu", "bindi", "tippi", "visarga"):
                out.append(("a" if open_ else "") + ("h" if sound == "visarga" else "n"))
                open_ = False
        elif kind.startswith("VOWEL SIGN"):
            out.append(sound)
            open_ = False
        elif kind.startswith("LETTER"):
            if open_:
                out.append("a")
            open_ = len(sound) > 1 and sound.endswith("a") and sound[0] not in "aeiou"
            out.append(sound[:-1] if open_ else sound)
        elif kind == "DIGIT":
            if open_:
                out.append("a")
            open_ = False
            out.append(str(unicodedata.digit(ch)))
    if open_ and len(out) == 1:
        out.append("a")
    return "".join(out)


@dataclass(frozen=True)
class Dictionary:
    """best: Indic token to its most common Latin rendering; second: to a runner-up that is common enough.

    fallback renders a token that best lacks, ``romanise`` by default; its result is replaced by a known rendering of
    the same consonant skeleton.
    """

    best: dict[str, str] = field(default_factory=dict)
    second: dict[str, str] = field(default_factory=dict)
    fallback: Callable[[str], str] | None = romanise

    def _known(self) -> dict[str, str]:
        table = self.__dict__.get("_by_skeleton")
        if table is None:
            table = {}
            for w in sorted(set(self.best.values()), reverse=True):
                table[skeleton(w)] = w
            object.__setattr__(self, "_by_skeleton", table)
        return table

    def token(self, token: str) -> tuple[str, bool]:
        """(rendering, whether the dictionary lacks it)"""
        if not is_indic(token):
            return token, False
        key = bare(token)
        if key in self.best:
            return self.best[key], False
        made = self.fallback(key) if self.fallback else ""
        made = re.sub("[^a-z0-9]", "", without_accents(made).lower())
        return (self._known().get(skeleton(made), made) if made else ""), True

    def text(self, text: str) -> tuple[str, int]:
        """(text with its tokens rendered, how many of them the dictionary lacks)"""
        if not is_indic(text):
            return text, 0
        done = [self.token(t) for t in text.split()]
        return " ".join(t for t, _ in done if t), sum(missing for _, missing in done)

    def runner_up(self, text: str) -> str:
        """The text with second renderings where there are any, else empty."""
        if not self.second or not is_indic(text):
            return ""
        tokens = text.split()
        other = [self.second.get(bare(t) if is_indic(t) else t) for t in tokens]
        if all(o is None for o in other):
            return ""
        return " ".join(o if o is not None else self.token(t)[0] for t, o in zip(tokens, other, strict=True))
