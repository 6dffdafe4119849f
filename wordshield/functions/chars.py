"""Character tables and classes of the scanner."""

from __future__ import annotations

# Leetspeak characters and the letters they stand for, likeliest first.
LEET: dict[str, str] = {
    "4": "a", "@": "a", "8": "b", "(": "c", "{": "c", "<": "c", "[": "c", "3": "e", "&": "ec", "6": "g",
    "9": "g", "#": "h", "1": "li", "!": "i", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t",
    "2": "z", "%": "x",
}

# Look-alike characters and the Latin letter that each is read as, after NFKC and lower-casing.
HOMOGLYPHS: dict[str, str] = {
    "а": "a", "α": "a", "ɑ": "a", "ā": "a", "ă": "a", "ą": "a", "à": "a", "á": "a", "â": "a", "ã": "a",
    "в": "b", "ƀ": "b",
    "с": "c", "ç": "c", "ċ": "c", "ĉ": "c",
    "е": "e", "ε": "e", "è": "e", "é": "e", "ê": "e", "ē": "e", "ĕ": "e", "ė": "e", "ę": "e", "ě": "e", "3": "e",
    "ɢ": "g",
    "һ": "h", "н": "h",
    "і": "i", "є": "i", "ı": "i", "ì": "i", "í": "i", "î": "i", "ĩ": "i", "ī": "i", "ĭ": "i", "į": "i",
    "ј": "j", "ϳ": "j",
    "к": "k", "ĸ": "k",
    "1": "l",
    "м": "m",
    "η": "n", "ñ": "n",
    "о": "o", "ο": "o", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ō": "o", "ŏ": "o", "ő": "o", "0": "o",
    "р": "p", "ρ": "p",
    "я": "r",
    "ѕ": "s", "ς": "s", "ʂ": "s", "5": "s",
    "т": "t", "τ": "t", "7": "t",
    "ν": "v",
    "ω": "w",
    "х": "x", "χ": "x",
    "у": "y", "υ": "y", "љ": "y",
    "ζ": "z", "ᴢ": "z",
}

#: Sources and targets for translate().
HOMOGLYPH_FROM = "".join(HOMOGLYPHS)
HOMOGLYPH_TO = "".join(HOMOGLYPHS.values())
LEET_FROM = "".join(LEET)
LEET_TO = "".join(letters[0] for letters in LEET.values())

ALNUM = r"\p{L}\p{N}"
LEET_CLASS = r"4@8({<\[3&69#1!|0$57+2%"
#: White space as Unicode-aware string libraries see it; Java's \s has less.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
