"""Column functions over text: languages, options, answers, masks, names and ids. All stay in generated code."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges that count as Chinese.
CHINESE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}]"


def detect_lang(text: Column) -> Column:
    """zh if a quarter or more of the characters that aren't white space are Chinese, else en; empty or null is zh."""
    bare = F.regexp_replace(text, r"\s", "")
    share = (F.length(bare) - F.length(F.regexp_replace(bare, CHINESE, ""))) / F.length(bare)
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, "zh").when(share >= 0.25, "zh").otherwise("en")


def norm_lang(code: Column) -> Column:
    return F.when(F.lower(F.trim(code)) == "en", "en").otherwise("zh")


def answer_letters(answer: Column) -> Column:
    """Distinct letters A to J in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit("([A-J])"), 1))), "")


def answer_numbers(answer: Column) -> Column:
    """A to F as 1 to 6; anything else goes."""
    return F.translate(F.regexp_replace(answer, "[^A-F]", ""), "ABCDEF", "123456")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is worked out once however often then names it, in lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def options_block(options: Column) -> Column:
    """`X. text` lines of a letter-to-text map, by letter, without blank ones."""
    entries = F.filter(F.array_sort(F.map_entries(options)), lambda e: F.trim(e["value"]) != "")
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), F.trim(e["value"]))), "\n")


def parsed_options(block: Column) -> Column:
    """Letter-to-text map of lines that start with a letter A to J and a mark or a space; of equal letters the last.

    Where no line does, of two or more places in a line with a letter and a mark; such a text ends at the next letter
    A to J in either case, and blank ones go.
    """
    line, inline = r"(?m)^[ \t]*([A-Ja-j])(?:[ \t]*[.、:：)）][ \t]*|[ \t]+)(\S[^\n]*?)[ \t\r]*$", r"([A-Ja-j])\s*[.、:：)）]\s*([^A-Ja-j]*)"
    found = lambda own, pattern: F.arrays_zip(F.regexp_extract_all(own, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(own, F.lit(pattern), 2).alias("v"))
    several = lambda places: F.when(F.size(places) >= 2, F.filter(places, lambda p: F.trim(p["v"]) != "")).otherwise(F.filter(places, lambda p: F.lit(False)))
    return once(block, lambda own: last_of_each(once(found(own, line), lambda lines: F.when(F.size(lines) > 0, lines).otherwise(once(found(own, inline), several)))))


def listed_options(values: Column) -> Column:
    """Letter-to-text map of a list: a text's own letter (with or without a mark), else that of its place; nulls go."""
    pattern = r"^([A-Ja-j])\s*[.、:：)）]?\s*(.+)$"

    def pair(v, i):
        text = F.trim(v)
        place = F.when(i < 26, F.char(i + 65)).otherwise(i.cast("string"))
        own = text.rlike(pattern)
        return F.struct(F.when(own, F.regexp_extract(text, pattern, 1)).otherwise(place).alias("k"), F.when(own, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("v"))

    return last_of_each(F.transform(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: p["v"].isNotNull()), lambda p: pair(p["v"], p["i"])))


def named_options(values: Column) -> Column:
    """Letter-to-text map of a map: of each key its first letter in upper case, ? for an empty one; null texts go."""
    entries = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull())
    letter = lambda k: F.when(F.trim(k) == "", "?").otherwise(F.upper(F.substring(F.trim(k), 1, 1)))
    return last_of_each(F.transform(entries, lambda e: F.struct(letter(e["key"]).alias("k"), e["value"].alias("v"))))


def last_of_each(pairs: Column) -> Column:
    """Map of an array of struct(k, v), keys in upper case and texts trimmed; of equal keys the last."""
    upper = F.transform(pairs, lambda p, i: F.struct(F.upper(p["k"]).alias("k"), F.trim(p["v"]).alias("v"), i.alias("i")))
    last = once(upper, lambda own: F.filter(own, lambda p: ~F.exists(own, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"]))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def keyword_any(text: Column, words: Sequence[str]) -> Column:
    """Whether text holds one of words, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word.lower())
    return found


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def mapped(key: Column, values: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, v).otherwise(out)
    return out


def json_object(text: Column) -> Column:
    """From the first brace to the last one, without a code fence; null if there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentence_joined(title: Column, content: Column) -> Column:
    """Title, closed by a full stop if it isn't closed, and content."""
    return F.when(F.trim(title).rlike("[.?!]$"), F.concat_ws(" ", F.trim(title), content)).otherwise(F.concat_ws(" ", F.concat(F.trim(title), F.lit(".")), content))


def tagged(text: Column, tag: str) -> Column:
    """The body of the first such element, or an empty string."""
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def section_numbers(text: Column) -> Column:
    """[1, 2] of `Section 1.2`; null without such a number."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def snake_to_camel(name: Column) -> Column:
    parts = F.split(F.lower(name), "_")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.left(x, F.lit(1))), F.right(x, F.length(x) - 1)))), "")


def padded_left(text: Column, size: int, fill: str) -> Column:
    """To size characters; of a longer text the last ones."""
    return F.right(F.concat(F.lit(fill * size), text), F.lit(size))


def half_width(text: Column) -> Column:
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(text, wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def full_width(text: Column) -> Column:
    narrow = "".join(chr(0x21 + i) for i in range(94)) + " "
    return F.translate(text, narrow, "".join(chr(0xFF01 + i) for i in range(94)) + "　")


# Masks by kind of personal data, pattern and what replaces it.
MASKS = {
    "username": (r"(\S)\S(\S*)", "$1*$2"),
    "id_card": (r"(\d{4})\d{10}(\d{4})", "$1** **** ****$2"),
    "phone": (r"(\d{3})\d{4}(\d{4})", "$1****$2"),
    "email": (r"(^.)[^@]*(@.*$)", "$1****$2"),
    "bank_card": (r"\d{15}(\d{3})", "**** **** **** **** $1"),
}


def hidden(text: Column, start: int, end: int, mark: str = "*") -> Column:
    """The text with its characters from start (counted from 0) to before end replaced by marks, as far as it has them."""
    n = F.greatest(F.lit(0), F.least(F.lit(end), F.length(text)) - start)
    return F.concat(F.left(text, F.lit(start)), F.repeat(F.lit(mark), n), F.right(text, F.greatest(F.lit(0), F.length(text) - F.lit(start) - n)))


def masked(value: Column, kind: str) -> Column:
    """Personal data with its middle hidden; a password gives stars only, a blank one and a blank plate nothing.

    Plates of 7 characters lose the 4th to the 6th, of 8 the 4th to the 7th; others stay as they are.
    """
    if kind == "password":
        return F.when(F.regexp_replace(value, r"\s", "") == "", "").otherwise(F.repeat(F.lit("*"), F.length(value)))
    if kind == "plate":
        size = F.length(value)
        return F.when(F.regexp_replace(value, r"\s", "") == "", "").when(size == 7, hidden(value, 3, 6)).when(size == 8, hidden(value, 3, 7)).otherwise(value)
    return F.regexp_replace(value, *MASKS[kind])


def contains_any(parts: Column, words: Sequence[str], fold: bool = False) -> Column:
    """Whether an array has one of words, in any case if fold."""
    if fold:
        return F.arrays_overlap(F.transform(parts, F.lower), F.array(*[F.lit(w.lower()) for w in words]))
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))


def quoted(text: Column) -> Column:
    """A pattern of the text itself, whatever marks it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def split_list(text: Column, mark: str = ",", trim: bool = True, drop_blank: bool = True) -> Column:
    """The parts of a separated text, trimmed and without blank ones if asked; null and empty texts give no parts."""
    parts = F.split(F.coalesce(text, F.lit("")), quoted(F.lit(mark)))
    if drop_blank:
        parts = F.filter(parts, lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x)) if trim else parts


def filled(template: str, *values: Column) -> Column:
    """The template with each `{}` replaced by the next value; a backslash before it keeps it as it is."""
    out, rest = [], template
    left = list(values)
    while left and "{}" in rest:
        head, _, rest = rest.partition("{}")
        if head.endswith("\\") and not head.endswith("\\\\"):
            out.append(F.lit(head[:-1] + "{}"))
            continue
        out += [F.lit(head[:-1] if head.endswith("\\\\") else head), left.pop(0).cast("string")]
    return F.concat(*out, F.lit(rest))


def is_http(text: Column) -> Column:
    return F.coalesce(text.startswith("http://") | text.startswith("https://"), F.lit(False))


def link_path(url: Column) -> Column:
    """A link as a route: without its scheme and www., dots and colons as slashes."""
    out = url
    for old, new in (("http://", ""), ("https://", ""), ("www.", ""), (".", "/"), (":", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def message_key(messages: Column, seed: Column, model: Column, mode: Column) -> Column:
    """The cache key of a model call: sha1 of messages as JSON, seed, model and mode."""
    return F.sha1(F.concat_ws("#", F.to_json(messages), seed.cast("string"), model, mode.cast("string")))


def canonical_digest(config: Mapping[str, object]) -> str:
    """sha256 of a configuration as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def persona_seed(key: Column) -> Column:
    """The first 8 hexadecimal digits of sha1, mod 100000."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 100000).cast("long")


def trajectory_key(uid: Column, text: Column) -> Column:
    return F.sha1(F.concat(uid, F.lit("||"), F.trim(text)))


def chance(seed: int, *keys: Column) -> Column:
    """A digest to order rows by: random, but the same in every run."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def true_word(text: Column) -> Column:
    """Yes and no words to booleans, null otherwise."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "ok", "1"), True).when(low.isin("false", "no", "0"), False)


def converted(text: Column, kind: str, default: object) -> Column:
    """A trimmed text as a value of kind; what isn't one, null or blank, is the default."""
    return F.coalesce(F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast(kind), F.lit(default).cast(kind))


def converted_list(text: Column, kind: str, mark: str = ",") -> Column:
    """The parts of a separated text as values of kind; parts that aren't one are null."""
    return F.transform(split_list(text, mark), lambda x: x.try_cast(kind))


def sequence_id(prefix: Column, n: Column) -> Column:
    """`source-000001`."""
    return F.concat(prefix, F.lit("-"), F.lpad(n.cast("string"), 6, "0"))


def file_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


# Kinds of pictures by their first bytes, as hexadecimal digits.
MAGIC = {"GIF": ("474946383761", "474946383961"), "JPG": ("4A464946", "45786966"), "BMP": ("424D",), "PNG": ("89504E47",)}


def picture_type(data: Column) -> Column:
    """GIF, JPG, BMP or PNG by a picture's first bytes (a JPG's are from its 7th on); JPG for any other."""
    head = F.hex(F.substring(data, 1, 10))
    out = F.lit("JPG")
    for kind in ("PNG", "BMP", "GIF"):
        for digits in MAGIC[kind]:
            out = F.when(head.startswith(digits), kind).otherwise(out)
    return F.when(F.substring(head, 13, 8).isin(*MAGIC["JPG"]), "JPG").otherwise(out)


def ant_pattern(pattern: str) -> str:
    """? is one character, * any but a slash, ** any, as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "/_" else pattern[i]), i + 1
    return f"^{out}$"
