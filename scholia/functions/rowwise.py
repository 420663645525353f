"""Functions that no built-in expression covers, over Arrow batches."""

from __future__ import annotations

import html
import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits and units of amounts in Chinese capitals; tags and attributes that the sanitizer keeps.
DIGITS, PLACES, GROUPS = "零壹贰叁肆伍陆柒捌玖", ["", "拾", "佰", "仟"], ["元", "万", "亿"]
KEPT = {"a": {"href", "target"}, "img": {"src", "width", "height", "alt"}, "b": set(), "strong": set(), "i": set(), "em": set()}
PROTOCOLS = ("http", "mailto", "https")


def capital_number(n: int) -> str:
    """A whole number in Chinese capitals, of any size; nothing for 0."""
    if n >= 10**8:
        high, low = divmod(n, 10**8)
        return capital_number(high) + GROUPS[2] + (DIGITS[0] if low and low < 10**7 else "") + capital_number(low)
    out, gap = "", False
    for k in reversed(range(8)):
        d = n // 10**k % 10
        if d:
            out += (DIGITS[0] if gap and out else "") + DIGITS[d] + PLACES[k % 4]
        gap = not d
        if k == 4 and n >= 10**4:
            out += GROUPS[1]
    return out


def capital_amount(x: float | None) -> str | None:
    """An amount in Chinese capitals, to whole hundredths; what isn't a finite number gives null."""
    if x is None or not math.isfinite(x):
        return None
    cents = round(abs(x) * 100)
    tenths, hundredths = cents // 10 % 10, cents % 10
    whole = capital_number(cents // 100)
    whole += GROUPS[0] if whole else ""
    small = (DIGITS[tenths] + "角" if tenths else "") + (DIGITS[hundredths] + "分" if hundredths else "")
    text = (whole + small if small else whole + "整") if whole or small else "零元整"
    return ("负" if x < 0 and cents else "") + text


def escaped(text: str) -> str:
    """Every UTF-16 unit as %xx, or as %uxxxx from 256 on."""
    units = text.encode("utf-16-be", "surrogatepass")
    codes = [units[i] << 8 | units[i + 1] for i in range(0, len(units), 2)]
    return "".join(f"%{c:02x}" if c < 256 else f"%u{c:04x}" for c in codes)


def unescaped(text: str) -> str:
    parts = re.split(r"(%u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2})", text)
    units = b"".join(int(p.lstrip("%u"), 16).to_bytes(2, "big") if i % 2 else p.encode("utf-16-be") for i, p in enumerate(parts))
    return units.decode("utf-16-be", "replace")


ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s]+))""")


def linked_value(value: str) -> str:
    """A link of a protocol that is kept, or with it replaced by #."""
    protocol = re.match(r"([^:]+):", value)
    if not protocol or protocol[1].lower() in PROTOCOLS or "/" in protocol[1]:
        return value
    rest = "#" + value[len(protocol[0]) :]
    return "#" + rest[3:] if rest.startswith("#//") else rest


def sanitized(text: str) -> str:
    """HTML with the kept tags only, closed in order; comments and other tags go, their text stays, escaped.

    Attributes may be quoted or not; links of other protocols become anchors; kept pairs without content go, and so do
    those that this empties.
    """
    out, opened = [], []
    for mark, words in re.findall(r"(?s)(<!--.*?-->|</?[A-Za-z][^<>]*>)|([^<]+|<)", text):
        if words:
            out.append(html.escape(html.unescape(words), quote=False))
            continue
        found = re.match(r"<(/?)([A-Za-z][A-Za-z0-9]*)(.*?)/?>$", mark, re.S)
        if not found or found[2].lower() not in KEPT:
            continue
        closing, tag = found[1], found[2].lower()
        if closing:
            if tag in opened:
                while opened[-1] != tag:
                    out.append(f"</{opened.pop()}>")
                opened.pop()
                out.append(f"</{tag}>")
            continue
        attrs = ""
        for name, *given in ATTRIBUTE.findall(found[3]):
            value, name = html.unescape("".join(given)).strip(), name.lower()
            if name in KEPT[tag]:
                attrs += f' {name}="{html.escape(linked_value(value) if name in ("href", "src") else value)}"'
        if tag == "img":
            out.append(f"<img{attrs} />")
        else:
            out.append(f"<{tag}{attrs}>")
            opened.append(tag)
    whole, before = "".join(out) + "".join(f"</{t}>" for t in reversed(opened)), None
    while whole != before:
        before, whole = whole, re.sub(r"<(a|b|strong|i|em)(?:\s[^<>]*)?></\1>", "", whole)
    return whole


def decision(text: str | None) -> bool | None:
    """approved of a JSON object, fenced or not, with a boolean approved, a string reason and no other or repeated field."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated field")
        return dict(pairs)

    try:
        bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
        found = json.loads(bare, object_pairs_hook=once)
    except ValueError:
        return None
    good = isinstance(found, dict) and set(found) == {"approved", "reason"} and isinstance(found["approved"], bool) and isinstance(found["reason"], str)
    return found["approved"] if good else None


def recursive_chunks(text: str, size: int = 1000, overlap: int = 200, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most size characters, cut at the first of marks that does, which share up to overlap at their ends."""
    mark = next((m for m in marks if m == "" or m in text), "")
    rest = marks[marks.index(mark) + 1 :]
    parts = [p for p in (text.split(mark) if mark else list(text)) if p]
    out: list[str] = []
    held: list[str] = []

    def joined() -> None:
        whole = mark.join(held).strip()
        if whole:
            out.append(whole)

    def width(extra: int = 0) -> int:
        return sum(map(len, held)) + len(mark) * max(0, len(held) - 1 + (1 if extra else 0)) + extra

    for part in parts:
        if len(part) >= size and rest:
            joined()
            held = []
            out += recursive_chunks(part, size, overlap, rest)
            continue
        if held and width(len(part)) > size:
            joined()
            while held and (width() > overlap or width(len(part)) > size):
                held.pop(0)
        held.append(part)
    joined()
    return out


def _mapped(f, kind: T.DataType):
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else f(x)), kind)


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunked(s: pd.Series) -> pd.Series:
    return s.map(lambda x: recursive_chunks((x or "").strip()))


amount_in_words = _mapped(capital_amount, T.StringType())
escape = _mapped(escaped, T.StringType())
unescape = _mapped(unescaped, T.StringType())
sanitize = _mapped(sanitized, T.StringType())
moderation = _mapped(decision, T.BooleanType())
