"""Text of bytes in an unknown encoding, found by the pairs of signs that it would make."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

#: Encodings that are tried where bytes are no UTF-8, in order: of equal ones the first is taken.
CANDIDATES = ("cp1252", "cp1251", "koi8-r", "iso8859-7", "shift_jis", "euc-jp", "gb18030", "big5", "euc-kr")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Bytes that are looked at to tell the encoding, from places all over the text; all of it is decoded.
WINDOW, WINDOWS = 4096, 16


@functools.cache
def _class(sign: str) -> str:
    """A sign's script and case: what it may stand beside."""
    if sign < "\x80":
        return "a" if sign.islower() else "A" if sign.isupper() else " " if sign.isspace() or sign.isdigit() or sign in ".,;:!?()'\"-/" else "#"
    kind, name = unicodedata.category(sign), unicodedata.name(sign, "")
    script = next((s for s in ("LATIN", "CYRILLIC", "GREEK", "HIRAGANA", "KATAKANA", "CJK", "HANGUL") if name.startswith(s)), "")
    if kind[0] == "L" and not name.startswith("HALFWIDTH"):
        return {"LATIN": "a" if kind == "Ll" else "A", "CYRILLIC": "c" if kind == "Ll" else "C", "GREEK": "g" if kind == "Ll" else "G", "HIRAGANA": "h", "KATAKANA": "h", "CJK": "k", "HANGUL": "n"}.get(script, "#")
    return "," if name.startswith(("IDEOGRAPHIC", "FULLWIDTH", "KATAKANA")) or sign in "«»„“”’‘–—…\xa0€°" else "#"


@functools.cache
def _worth(pair: str) -> float:
    """How likely two classes stand side by side in a text: letters of one script and case do, or a capital before small ones;
    a capital after a small letter, scripts side by side, and signs that are rare in texts do not."""
    x, y = pair
    if "#" in pair:
        return -3.0
    if x in " ," or y in " ,":
        return 0.0
    if x.lower() != y.lower():
        return 0.5 if pair in ("hk", "kh") else -2.0
    if x.islower() and y.isupper():
        return -2.0
    return {"h": 1.5, "k": 0.4, "n": 1.0}.get(x, 1.0 if y.islower() else 0.0)


def plausibility(text: str) -> float:
    """The mean worth of the pairs of which a sign is beyond ASCII."""
    kinds = [_class(s) for s in text]
    pairs = [x + y for x, y, a, b in zip(kinds, kinds[1:], text, text[1:]) if a >= "\x80" or b >= "\x80"]
    return sum(map(_worth, pairs)) / len(pairs) if pairs else 0.0


def _sampled(data: bytes) -> bytes:
    if len(data) <= WINDOW * WINDOWS:
        return data
    step = (len(data) - WINDOW) // (WINDOWS - 1)
    return b"".join(data[at : at + WINDOW] for at in range(0, len(data) - WINDOW + 1, step))


def detected(data: bytes) -> tuple[str, str, int]:
    """(text, encoding, replaced): by its byte order mark, as UTF-8, as UTF-16 without a mark, else the candidate that
    decodes all of it to the most plausible text. Where none does, UTF-8 with U+FFFD for what is not valid, counted."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            try:
                return data.decode(name), name.removesuffix("-sig"), 0
            except UnicodeDecodeError:
                break
    try:
        if b"\0" not in data:
            return data.decode("utf-8"), "utf-8", 0
    except UnicodeDecodeError:
        pass
    nulls = [data[k::2].count(0) / max(1, len(data[k::2])) for k in (0, 1)]
    wide = ["utf-16-le"] * (nulls[1] > 4 * nulls[0] + 0.05) + ["utf-16-be"] * (nulls[0] > 4 * nulls[1] + 0.05)
    best: tuple[float, str, str] | None = None
    for name in wide or CANDIDATES:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        score = plausibility(_sampled(data).decode(name, errors="ignore")) + (10 if wide else 0)
        if best is None or score > best[0]:
            best = (score, text, name)
    if best is not None and (wide or best[0] > 0):
        return best[1], best[2], 0
    text = data.decode("utf-8", errors="replace")
    return text, "utf-8", text.count("�")


def decoded(content: Column) -> Column:
    """(text, encoding, replaced) of binary content; of a null one, nulls."""

    def made(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if x is None else detected(bytes(x)) for x in column], columns=["text", "encoding", "replaced"]).astype({"replaced": "Int64"})

    return F.pandas_udf(made, "text string, encoding string, replaced long", PandasUDFType.SCALAR)(content)
