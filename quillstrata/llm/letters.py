"""Letter codes of whole texts as numpy arrays, for the character-level classifiers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Codes: 0 separator, 1-26 a-z, 27-60 other letters, 61 dropped, 62 and 63 token edges (put in by tokens()).
DROP, FIRST_EDGE, LAST_EDGE = 61, 62, 63
#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@lru_cache(maxsize=2)
def table(lookalikes: bool) -> np.ndarray:
    """Code of each code point of the basic plane. With lookalikes, signs inside words are dropped or read as letters; without, all but letters separates."""
    out = np.full(65536, DROP if lookalikes else 0, np.uint8)
    for cp in range(65536):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        if ch.isspace():
            out[cp] = 0
        elif ch.isalpha():
            low = ch.lower()[0]
            if "a" <= low <= "z":
                out[cp] = ord(low) - 96
            else:
                out[cp] = 27 + ord(low) % 34
        elif unicodedata.category(ch) == "Mn":
            out[cp] = DROP
    if lookalikes:
        for a, b in LOOKALIKES.items():
            out[ord(a)] = ord(b) - 96
    return out


def codes(texts: list[str], lookalikes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each closed by a separator, dropped signs left out; and where each text ends."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    code = table(lookalikes)[np.where(cp < 65536, cp, 0x4E00 + (cp & 0xFFF))]
    ends = np.cumsum([len(t) + 1 for t in texts])
    stay = code != DROP
    return code[stay], np.cumsum(stay)[ends - 1]
