"""Column functions of the assistant's front: intents and routes, signs of understanding, styles, locales, menu paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import link_path, mapped

# Intents with their routes, other names of intents, and keywords of intents in the order tried.
ROUTES = {"course": "/course", "slide_gen": "/slideGen", "practice": "/exam", "case": "/case", "past": "/pastlist", "forum": "/forum", "chat": None}
INTENT_NAMES = {"slidegen": "slide_gen", "slide": "slide_gen", "slides": "slide_gen", "ppt": "slide_gen", "presentation": "slide_gen", "exercise": "practice", "exam": "practice", "quiz": "practice", "cases": "case", "history": "past", "pastlist": "past", "community": "forum", "discussion": "forum"}
INTENT_WORDS = [
    ("slide_gen", ["slide", "slides", "ppt", "presentation", "courseware", "幻灯片", "演示文稿", "课件", "课件生成", "生成课件", "生成ppt"]),
    ("practice", ["practice", "exercise", "exam", "quiz", "test", "练习", "刷题", "题目", "考试", "测验", "做题"]),
    ("case", ["case report", "clinical case", "patient simulation", "病例", "病案", "案例", "患者模拟", "病例训练", "病例分析"]),
    ("past", ["past", "history", "record", "previous", "learning history", "notes", "report", "reports", "历史", "记录", "学习记录", "过往", "以前", "笔记", "报告"]),
    ("forum", ["forum", "post", "posts", "community", "discussion", "peer", "论坛", "帖子", "发帖", "社区", "讨论", "交流"]),
    ("course", ["course", "class", "lesson", "lecture", "chapter", "learn", "study", "课程", "上课", "去上课", "听课", "学习", "章节", "知识点", "讲义", "授课"]),
]
# What says that a student has understood.
UNDERSTOOD = ["明白了", "懂了", "理解了", "我知道了", "清楚了", "了解了", "好的我明白", "不用再问了", "够了", "可以了", "掌握了", "学会了", "i understand", "got it", "i see", "makes sense", "clear now", "no more questions", "that's enough", "i'm good", "understand now", "i got it", "makes total sense"]
# Styles by number, styles and colours by other names, in the order tried; the first of each is the default.
STYLE_NUMBERS = {"1": "简约", "2": "商务", "3": "清新", "4": "活泼"}
STYLES = {"简约": ["简约", "minimal", "minimalist", "minimalis", "न्यूनतम"], "商务": ["商务", "business", "perniagaan", "व्यावसायिक"], "清新": ["清新", "fresh", "segar", "ताज़ा", "ताजा"], "活泼": ["活泼", "vibrant", "ceria", "जीवंत"]}
COLOURS = {"蓝色": ["蓝色", "blue", "biru", "नीला"], "红色": ["红色", "red", "merah", "लाल"], "绿色": ["绿色", "green", "hijau", "हरा"], "橙色": ["橙色", "orange", "jingga", "नारंगी"], "紫色": ["紫色", "purple", "ungu", "बैंगनी"]}


# Names of styles and colours by locale.
STYLE_LABELS = {
    "简约": {"zhcn": "简约", "enus": "Minimal", "malay": "Minimalis", "hindi": "न्यूनतम"}, "商务": {"zhcn": "商务", "enus": "Business", "malay": "Perniagaan", "hindi": "व्यावसायिक"},
    "清新": {"zhcn": "清新", "enus": "Fresh", "malay": "Segar", "hindi": "ताज़ा"}, "活泼": {"zhcn": "活泼", "enus": "Vibrant", "malay": "Ceria", "hindi": "जीवंत"},
    "蓝色": {"zhcn": "蓝色", "enus": "Blue", "malay": "Biru", "hindi": "नीला"}, "红色": {"zhcn": "红色", "enus": "Red", "malay": "Merah", "hindi": "लाल"}, "绿色": {"zhcn": "绿色", "enus": "Green", "malay": "Hijau", "hindi": "हरा"},
    "橙色": {"zhcn": "橙色", "enus": "Orange", "malay": "Jingga", "hindi": "नारंगी"}, "紫色": {"zhcn": "紫色", "enus": "Purple", "malay": "Ungu", "hindi": "बैंगनी"},
}


def _any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in dict.fromkeys(words):
        found = found | text.contains(word.lower())
    return found


def intent(name: Column) -> Column:
    """An intent by one of its names, - and blanks as _; null if it is none."""
    own = F.regexp_replace(F.lower(F.trim(name)), "[- ]", "_")
    found = own
    for other, value in INTENT_NAMES.items():
        found = F.when(own == other, value).otherwise(found)
    return F.when(found.isin(*ROUTES), found)


def intent_of_text(text: Column) -> Column:
    """The first intent with a keyword in the text, else chat."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit("chat")
    for name, words in reversed(INTENT_WORDS):
        out = F.when(_any(low, words), name).otherwise(out)
    return out


def routed(name: Column, role: Column, level: Column) -> Column:
    """struct(route, should_route, blocked) of an intent: role 3 makes no slides, level 1 has courses and practice only."""
    role, level = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(level.cast("string"), F.lit(""))
    blocked = F.when((name == "slide_gen") & (role == "3"), "student_role_no_slide_gen").when((level == "1") & name.isin("case", "past", "forum", "slide_gen"), "level_1_route_restricted")
    route = F.when(blocked.isNull(), F.nullif(mapped(name, {k: v for k, v in ROUTES.items() if v}, ""), F.lit("")))
    return F.struct(route.alias("route"), route.isNotNull().alias("should_route"), blocked.alias("blocked"))


def understood(text: Column) -> Column:
    """Whether a reply has a sign of understanding."""
    return _any(F.lower(F.trim(F.coalesce(text, F.lit("")))), UNDERSTOOD)


def slide_style(text: Column) -> Column:
    """struct(style, colour) of a free reply: the first name found, else the first number, else the defaults."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def first(names: Mapping[str, Sequence[str]], other: Column) -> Column:
        out = other
        for value, words in reversed(list(names.items())):
            out = F.when(_any(low, words), value).otherwise(out)
        return out

    number = F.lit(next(iter(STYLES)))
    for digit, value in reversed(list(STYLE_NUMBERS.items())):
        number = F.when(low.contains(digit), value).otherwise(number)
    return F.struct(first(STYLES, number).alias("style"), first(COLOURS, F.lit(next(iter(COLOURS)))).alias("colour"))


def locale(code: Column) -> Column:
    """enus, zhcn, malay or hindi by any common form of a language code; zhcn for others."""
    own = F.regexp_replace(F.lower(F.coalesce(F.nullif(code, F.lit("")), F.lit("zhcn"))), "[-_]", "")
    return F.when(own.startswith("en"), "enus").when(own.startswith("zh"), "zhcn").when(own.isin("ms", "msmy", "malay"), "malay").when(own.isin("hi", "hiin", "hindi"), "hindi").otherwise("zhcn")


def message(code: Column, key: Column, messages: Mapping[str, Mapping[str, str]], params: Mapping[str, Column], default: str = "zhcn") -> Column:
    """The message of a key in a locale, else in the default one, else the key; `{name}` stands for a parameter.

    Parameters style and color are put into the locale first, where they are names of STYLE_LABELS.
    """
    text = F.coalesce(F.create_map(*[c for k, v in messages[default].items() for c in (F.lit(k), F.lit(v))])[key], key)
    own = locale(code)
    for name, table in messages.items():
        table = F.create_map(*[c for k, v in table.items() for c in (F.lit(k), F.lit(v))])
        text = F.when((own == name) & table[key].isNotNull(), table[key]).otherwise(text)
    for name, value in params.items():
        value = value.cast("string")
        if name in ("style", "color"):
            labels = F.create_map(*[F.lit(x) for k, of in STYLE_LABELS.items() for c, label in of.items() for x in (f"{k} {c}", label)])
            value = F.coalesce(labels[F.concat(value, F.lit(" "), own)], value)
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def chat_input(content: Column) -> Column:
    """What a user wrote beside a quoted block: before the first `<div` of a text with `<br>`, else before it and after
    the first `</div>`, else all."""
    before, after = F.substring_index(content, "<div", 1), F.get(F.split(content, "</div>"), F.lit(1))
    blank = F.trim(before) == ""
    return F.when(content.contains("<br>"), F.when(blank, "").otherwise(before)).when(content.contains("</div>"), F.when(blank, after).otherwise(F.concat(before, after))).otherwise(content)


def menu_route(name: Column, path: Column, parent: Column, kind: Column, framed: Column) -> dict[str, Column]:
    """name, path and component of a menu's route. kind: M a folder, C a page; framed: it opens in a frame of its own.

    A page at the top without a frame is the root and has no name; links inside the frame become paths.
    """
    top, inner = parent == 0, ~framed & (path.startswith("http://") | path.startswith("https://"))
    frame = top & (kind == "C") & ~framed
    own = F.coalesce(F.nullif(name, F.lit("")), path)
    route = F.when(top & (kind == "M") & ~framed, F.concat(F.lit("/"), path)).when(frame, "/").when(~top & inner, link_path(path)).otherwise(path)
    component = F.when(~top & inner, "InnerLink").when(~top & (kind == "M"), "ParentView").otherwise("Layout")
    return {"name": F.when(frame, "").otherwise(F.concat(F.upper(F.left(own, F.lit(1))), F.right(own, F.length(own) - 1))), "path": route, "component": component}
