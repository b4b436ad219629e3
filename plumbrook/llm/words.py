"""The words of a text as leak search and repetition measures count them."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")
#: Markup that separates words; longer brackets are text.
_TAG = re.compile(r"<[^<>]{0,40}>")


@lru_cache(maxsize=1)
def _invisible() -> re.Pattern[str]:
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
    return re.compile("[" + "".join(re.escape(chr(c)) for c in codes) + "]")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the lower-cased, NFKC-normalized text, without tags and format characters.

    Null and empty texts have no words.
    """
    if not text:
        return []
    # Format characters are not printable; the test is much faster than the search for them.
    if not text.isascii() and not text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
        text = _invisible().sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text)
