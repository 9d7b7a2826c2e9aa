"""Words of a text, for comparisons that pass over case, punctuation and digits."""

from __future__ import annotations

import re

_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits left out; a character of a script without word spaces is a word by itself."""
    return _WORD.findall(text.lower()) if text else []
