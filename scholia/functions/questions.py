"""Column functions that make questions: nodes, difficulties, languages, templates, option blocks and their traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import detect_lang, mapped, norm_lang, options_block, quoted

# Keywords of curriculum nodes, the first node with a hit wins; the node without a hit, and of other fields.
NODE_RULES = [
    ("ophthalmology/emergency/acute_angle_closure", ["闭角", "急性发作", "眼压升高", "高眼压", "急性充血", "抢救", "缩瞳", "甘露醇", "房角关闭", "angle closure", "acute attack", "raised intraocular", "intraocular pressure rise", "miotic", "mannitol"]),
    ("ophthalmology/glaucoma/medication_safety", ["噻吗洛尔", "毛果芸香碱", "缩瞳剂", "降眼压药", "前列腺素", "碳酸酐酶", "β受体阻滞", "滴眼液", "用药", "禁忌", "药物", "剂量", "timolol", "pilocarpine", "beta-blocker", "beta blocker", "prostaglandin", "carbonic anhydrase", "eye drops", "medication", "contraindication", "dosage"]),
    ("ophthalmology/retina/DR_staging", ["糖尿病视网膜病变", "糖网", "NPDR", "PDR", "微血管瘤", "新生血管", "视网膜病变", "眼底出血", "diabetic retinopathy", "microaneurysm", "neovascular", "neovascularization", "vitreous hemorrhage"]),
    ("ophthalmology/neuro_ophth/papilledema_vs_papillitis", ["视盘", "视乳头", "视神经", "视盘水肿", "视野缺损", "传入性瞳孔", "RAPD", "optic disc", "optic nerve", "papilledema", "papillitis", "visual field defect", "relative afferent pupillary", "RAPD"]),
    ("ophthalmology/cataract/preop_assessment", ["白内障", "晶状体混浊", "人工晶体", "IOL", "超声乳化", "术前评估", "cataract", "lens opacity", "intraocular lens", "IOL", "phacoemulsification", "preoperative"]),
    ("ophthalmology/refraction/astigmatism_axis", ["散光", "轴位", "验光", "交叉柱镜", "屈光", "近视", "远视", "检影", "astigmatism", "axis", "refraction", "cross cylinder", "myopia", "hyperopia", "retinoscopy", "spectacle"]),
    ("ophthalmology/retina/OCT_reading", ["OCT", "黄斑水肿", "玻璃膜疣", "CNV", "视网膜厚度", "optical coherence tomography", "macular edema", "drusen", "choroidal neovascularization", "retinal thickness"]),
    ("ophthalmology/retina/pathological_myopia", ["病理性近视", "高度近视", "近视性", "后巩膜葡萄肿", "pathological myopia", "high myopia", "myopic", "posterior staphyloma"]),
    ("ophthalmology/basic/anatomy_physics", ["解剖", "房水循环", "生理", "屈光介质", "光学", "泪膜", "anatomy", "aqueous humor", "circulation", "physiology", "optics", "tear film"]),
]
DEFAULT_NODE, GENERAL_NODE, MIXED_NODE = "ophthalmology/general/ophthalmology_qa", "general_medicine/qa", "ophthalmology/fundus/multilabel_reading"
# Nodes of image sources, and of the codes of one with several labels (N is normal).
IMAGE_SOURCE_NODE = {"idrid": "ophthalmology/retina/DR_staging", "octid": "ophthalmology/retina/OCT_reading", "kermany": "ophthalmology/retina/OCT_reading", "octdl": "ophthalmology/retina/OCT_reading", "palm": "ophthalmology/retina/pathological_myopia", "refuge": "ophthalmology/neuro_ophth/papilledema_vs_papillitis", "gamma": "ophthalmology/glaucoma/disc_evaluation"}
CODE_NODE = {"D": "ophthalmology/retina/DR_staging", "G": "ophthalmology/glaucoma/disc_evaluation", "C": "ophthalmology/cataract/preop_assessment", "A": "ophthalmology/retina/AMD_reading", "H": "ophthalmology/retina/hypertensive_retinopathy", "M": "ophthalmology/retina/pathological_myopia", "N": "ophthalmology/fundus/normal_reading", "O": "ophthalmology/fundus/multilabel_reading"}
CODED_SOURCE, ENGLISH_SOURCES = "odir", ["idrid", "odir", "refuge", "palm", "gamma", "octid", "kermany", "octdl"]
# Keywords of high and middle difficulty, labels of normal images.
HIGH_WORDS = ["急", "急性", "发作", "闭角", "抢救", "急救", "禁忌", "过敏", "中毒", "不良反应", "噻吗洛尔", "阿托品", "毛果芸香碱", "散瞳", "24小时", "48小时", "全身", "感染", "穿孔", "破裂", "acute", "attack", "emergency", "contraindica", "contraindication", "allerg", "toxic", "adverse", "timolol", "atropine", "pilocarpine", "dilation", "infection", "perforation", "rupture"]
MID_WORDS = ["手术", "术前", "计算", "鉴别", "分期", "剂量", "儿童", "孕妇", "并发症", "机制", "顺序", "原则", "surgery", "surgical", "preoperative", "calculat", "differential", "staging", "dosage", "child", "pregnan", "complication", "mechanism", "order", "principle"]
NORMAL_LABELS = ["正常", "无糖尿病视网膜病变", "normal", "no dr"]
# Tiers of difficulty, and those of hints.
TIERS = ["routine_clarification", "misconception_triggering", "difficult_diagnostic"]
HINT_TIERS = {"low": "routine_clarification", "mid": "misconception_triggering", "high": "difficult_diagnostic", "低": "routine_clarification", "中": "misconception_triggering", "高": "difficult_diagnostic"}
# learners' profiles by language and generality, then tier.
PROFILES = {
    ("zh", False): {"routine_clarification": "眼科规培一年级，基础概念尚不牢固，常混淆相近名词，目标是通过日常答疑补齐概念边界。", "misconception_triggering": "眼科规培一年级，能复述结论但概念边界模糊，容易把单一征象当成充分条件，目标是建立规范判读顺序。", "difficult_diagnostic": "眼科规培二年级，有一定阅片量，正在建立系统的鉴别诊断与急症处置思路，目标是独立完成病例分析。"},
    ("en", False): {"routine_clarification": "First-year ophthalmology resident; basic concepts still shaky, often confuses neighboring terms, aiming to firm up concept boundaries through daily Q&A.", "misconception_triggering": "First-year ophthalmology resident; can recite conclusions but the boundaries are blurry, tends to treat a single sign as sufficient, aiming to build a standard reading order.", "difficult_diagnostic": "Second-year ophthalmology resident with moderate reading volume, building systematic differential-diagnosis and emergency-management thinking, aiming to work up cases independently."},
    ("zh", True): {"routine_clarification": "临床规培一年级，正在内科/外科等科室轮转，基础概念尚不牢固，常混淆相近名词，目标是通过日常答疑补齐概念边界。", "misconception_triggering": "临床规培一年级，能复述结论但概念边界模糊，容易把单一征象或单一检查当成充分条件，目标是建立规范的鉴别思路。", "difficult_diagnostic": "临床规培二年级，有一定病例量，正在建立系统的鉴别诊断与急症处置思路，目标是独立完成病例分析。"},
    ("en", True): {"routine_clarification": "First-year clinical resident on rotation; basic concepts still shaky, often confuses neighboring terms, aiming to firm up concept boundaries through daily Q&A.", "misconception_triggering": "First-year clinical resident; can recite conclusions but the boundaries are blurry, tends to treat a single sign or single test as sufficient, aiming to build a standard diagnostic approach.", "difficult_diagnostic": "Second-year clinical resident with moderate case volume, building systematic differential-diagnosis and emergency-management thinking, aiming to work up cases independently."},
}
# How a student asks, by language, for an open question and for one with options.
ASKED = {
    "en": ("Dr., while reviewing my %s I got stuck on this: %s. I keep second-guessing myself when I try to judge it on my own — could you walk me through it step by step?", "reading of this image", "notes", "this question"),
    "zh": ("老师，我在看%s时遇到一个问题：%s。我自己判断时总有点拿不准，能带我从头梳理一遍思路吗？", "这张图像", "课堂笔记", "这道题"),
}
ASKED_OPTIONS = {
    "en": "Dr., I'm stuck on this question: %s\n%s\nI've tried ruling the options out on my own but keep second-guessing — could you walk me through how to judge each option, step by step?",
    "zh": "老师，我在做题时卡住了：%s\n%s\n我按自己的想法排除了一圈还是拿不准，能带我把每个选项的判断思路一步步过一遍吗？",
}
# Marks after an option's letter, phrases that ask for one of several, and what takes their place.
MARKS = "[.、:：)）]"
OPTION_LINE = rf"(?:^|\n)\s*[A-Ea-e]\s*{MARKS}\s*[^\n]*"
SELECTS = {"zh": (r"(?:下列|以下)(?:哪[一项项个种]*|那一项)?", "这个知识点中"), "en": (r"(?i)which\s+(?:one\s+)?of\s+the\s+following", "this concept")}
TRACES = {"zh": rf"(?:^|\n|\s)[A-E]{MARKS}|下列哪|以下哪", "en": rf"(?im)^\s*[A-E]\s*{MARKS}\s*\S|which\s+of\s+the\s+following"}
# Subjects, topics and frames of course texts.
COURSE = {
    "en": ("Ophthalmology", "Clinical medicine", "ophthalmology Q&A", "general Q&A", "%s · %s (Findings: %s)", "(no description)", "%s · %s (Key points: %s; Explanation: %s)"),
    "zh": ("眼科学", "临床医学", "眼科答疑", "综合问答", "%s·%s（检查所见：%s）", "（无描述）", "%s·%s（题目要点：%s；解析：%s）"),
}
COURSE_CHARS = 600
# What is said of an image without its label.
FINDINGS = {
    "en": ("DR grade code %s", "DME risk level %s", "%s eye", {}, "; ", " (dataset annotations: %s)", " (no structured annotations from the dataset)", "Findings (offline template): this image comes from a public fundus dataset%s. Student, please first describe what you see in disc -> vessels -> macula order; the teacher then guides qualitative -> localization -> quantification -> staging. The conclusion is reached through the teacher's step-by-step guidance."),
    "zh": ("DR 分级码 %s", "DME 风险等级 %s", "%s眼", {"left": "左", "right": "右"}, "；", "（数据集标注：%s）", "（数据集未附结构化标注）", "检查所见（离线模板）：本图来自公开眼底数据集%s，学生请先按视盘→血管→黄斑顺序描述所见，教师再按定性→定位→定量→分期引导判读。结论以带教老师逐步引导得出。"),
}


def _filled(template: str, *values: Column) -> Column:
    parts = template.split("%s")
    return F.concat(F.lit(parts[0]), *[c for v, rest in zip(values, parts[1:]) for c in (v, F.lit(rest))])


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _first(*values: Column) -> Column:
    """The first value that isn't empty."""
    out = values[-1]
    for v in reversed(values[:-1]):
        out = F.when(F.coalesce(v, F.lit("")) != "", v).otherwise(out)
    return out


def by_lang(lang: Column, make) -> Column:
    """What make gives for en where lang is that, else for zh."""
    return F.when(norm_lang(lang) == "en", make("en")).otherwise(make("zh"))


def has_word(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for word in dict.fromkeys(w.lower() for w in words):
        found = found | low.contains(word)
    return found


def text_node(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = NODE_RULES, default: str = DEFAULT_NODE) -> Column:
    """The first node with a keyword in the text, in any case; else the default."""
    out = F.lit(default)
    for node, words in reversed(rules):
        out = F.when(has_word(text, words), node).otherwise(out)
    return out


def image_node(source: Column, label: Column, codes: Column) -> Column:
    """The node of an image: by its source, of a source with codes (map of code to flag) the first set one, normal last.

    Other sources by the label's keywords, and without one several-label reading.
    """
    src = F.lower(F.coalesce(source, F.lit("")))
    hits = F.filter(F.map_entries(codes), lambda e: F.coalesce(e["value"], F.lit(False)) & e["key"].isin(*CODE_NODE))
    rest = F.filter(hits, lambda e: e["key"] != "N")
    code = F.coalesce(F.get(rest, F.lit(0))["key"], F.get(hits, F.lit(0))["key"], F.lit("O"))
    own = text_node(label)
    return F.when(src == CODED_SOURCE, mapped(code, CODE_NODE, CODE_NODE["O"])).when(src.isin(*IMAGE_SOURCE_NODE), mapped(src, IMAGE_SOURCE_NODE, MIXED_NODE)).when(own == DEFAULT_NODE, MIXED_NODE).otherwise(own)


def difficulty_hint(kind: Column, stem: Column, label: Column, n_wrong: Column) -> Column:
    """low, mid or high. Images: mid for normal labels, else high. Texts: by words of high difficulty, then mid where there
    are wrong options or words of middle difficulty, else low."""
    text = F.concat_ws(" ", F.coalesce(stem, F.lit("")), F.coalesce(label, F.lit("")))
    image = F.when(has_word(label, NORMAL_LABELS), "mid").otherwise("high")
    return F.when(kind == "image", image).when(has_word(text, HIGH_WORDS), "high").when((F.coalesce(n_wrong, F.lit(0)) > 0) | has_word(text, MID_WORDS), "mid").otherwise("low")


def difficulty_tier(hint: Column, proposed: Column) -> Column:
    """The proposed tier if there is one of that name, else the hint's, else the middle one."""
    own = F.trim(F.coalesce(proposed, F.lit("")))
    return F.when(own.isin(*TIERS), own).otherwise(mapped(F.lower(F.trim(F.coalesce(hint, F.lit("")))), HINT_TIERS, TIERS[1]))


def row_lang(kind: Column, source: Column, stem: Column, label: Column, forced: Column) -> Column:
    """A forced language, else that of a text's stem, en for the image sources that are so, else that of the label."""
    code = F.lower(F.trim(F.coalesce(forced, F.lit(""))))
    return F.when(code.isin("zh", "en"), code).when(kind == "text", detect_lang(stem)).when(F.lower(F.coalesce(source, F.lit(""))).isin(*ENGLISH_SOURCES), "en").otherwise(detect_lang(label))


def is_general(node: Column) -> Column:
    """Whether there is a node and it isn't of the field."""
    return ~_blank(node) & ~F.trim(F.coalesce(node, F.lit(""))).startswith("ophthalmology")


def without_options(stem: Column, lang: Column) -> Column:
    """A stem without its option lines and choosing phrases, in one line."""
    bare = F.regexp_replace(F.coalesce(stem, F.lit("")), OPTION_LINE, "")
    return F.trim(F.regexp_replace(by_lang(lang, lambda c: F.regexp_replace(bare, *SELECTS[c])), r"\s*\n\s*", " "))


def has_option_traces(text: Column, lang: Column) -> Column:
    return by_lang(lang, lambda c: F.coalesce(text, F.lit("")).rlike(TRACES[c]))


def asked(stem: Column, label: Column, options: Column, lang: Column, image: Column, with_options: Column) -> Column:
    """The student's question from a template; one with options needs some, else it is open."""
    block = options_block(options)

    def make(code: str) -> Column:
        frame, picture, notes, nothing = ASKED[code]
        own = _first(stem, label, F.lit(nothing))
        plain = _filled(frame, F.when(image, picture).otherwise(notes), without_options(own, F.lit(code)))
        return F.when(with_options & (F.coalesce(block, F.lit("")) != ""), _filled(ASKED_OPTIONS[code], F.trim(own), block)).otherwise(plain)

    return F.concat(F.when(image, "<image>").otherwise(""), by_lang(lang, make))


def by_profile(difficulty: Column, lang: Column, general: Column, tables: Mapping[tuple[str, bool], Mapping[str, str]] = PROFILES) -> Column:
    """The learner's profile of a difficulty (the middle one's for others) from tables by language and generality."""

    def of(code: str, wide: bool) -> Column:
        own = tables[code, wide]
        return mapped(difficulty, own, own[TIERS[1]])

    return by_lang(lang, lambda c: F.when(general, of(c, True)).otherwise(of(c, False)))


def misconception(wrong: Column, truth: Column, lang: Column) -> Column:
    """What is believed wrongly, from the first wrong option, and what is overlooked; empty without one."""
    first, own = F.trim(F.coalesce(F.get(wrong, F.lit(0)), F.lit(""))), F.trim(F.coalesce(truth, F.lit("")))

    def make(code: str) -> Column:
        base, more = ('mistakenly believes the answer is "%s"', ' while overlooking "%s"') if code == "en" else ("误以为正确答案是「%s」", "而忽略「%s」")
        return F.concat(_filled(base, first), F.when(own != "", _filled(more, own)).otherwise(""))

    return F.when(first == "", "").otherwise(by_lang(lang, make))


def course_text(node: Column, lang: Column, image: Column, finding: Column, stem: Column, explanation: Column, label: Column) -> Column:
    """Subject, topic and what is known of a question, to COURSE_CHARS characters."""
    own = F.coalesce(node, F.lit(""))
    topic = F.replace(F.regexp_extract(own, r"([^/]*)$", 1), F.lit("_"), F.lit(" "))
    empty = F.lit("")

    def make(code: str) -> Column:
        subject, general, none, wide, seen, nothing, text = COURSE[code]
        name, about = F.when(is_general(node), general).otherwise(subject), F.when(is_general(node), wide).when(own == "", none).otherwise(topic)
        return F.when(image, _filled(seen, name, about, _first(finding, F.lit(nothing)))).otherwise(_filled(text, name, about, F.coalesce(stem, empty), _first(explanation, F.coalesce(label, empty))))

    return F.left(by_lang(lang, make), F.lit(COURSE_CHARS))


def finding_text(grade: Column, risk: Column, side: Column, lang: Column) -> Column:
    """What may be said of an image: its codes and side, never its label."""

    def make(code: str) -> Column:
        grade_, risk_, side_, names, mark, known, none, frame = FINDINGS[code]
        eye = mapped(side, names, "") if names else side
        eye = F.when(F.coalesce(eye, F.lit("")) != "", eye).otherwise(side)
        parts = F.array_compact(F.array(F.when(~_blank(grade), _filled(grade_, grade)), F.when(~_blank(risk), _filled(risk_, risk)), F.when(F.coalesce(side, F.lit("")) != "", _filled(side_, eye))))
        return _filled(frame, F.when(F.size(parts) > 0, _filled(known, F.array_join(parts, mark))).otherwise(none))

    return by_lang(lang, make)


def one_line(text: Column) -> Column:
    """Line and paragraph separators as spaces, trimmed; null is empty."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "  ", "  "), r"(?U)^\s+|\s+$", "")


def flat_context(texts: Column, labels: Column) -> Column:
    """`LABEL: text` paragraphs of two lists. Nulls go from each list first, so places may shift; blank texts are left out,
    and a missing or blank label is CONTEXT."""
    own = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull())
    rows = F.transform(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda t, i: F.struct(F.trim(t).alias("t"), F.trim(F.coalesce(F.get(own, i), F.lit(""))).alias("l")))
    rows = F.filter(rows, lambda r: r["t"] != "")
    return F.array_join(F.transform(rows, lambda r: F.concat(F.when(r["l"] == "", "CONTEXT").otherwise(r["l"]), F.lit(": "), r["t"])), "\n\n")


def cut_context(text: Column, cap: int = 2400) -> Column:
    """Whole paragraphs to cap characters (the first one in any case, then cut hard), and ` [...]` where something is missing."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(s, p):
        full = s["full"] | ((s["used"] + F.length(p) + 2 > cap) & (F.size(s["kept"]) > 0))
        return F.struct(F.when(full, s["kept"]).otherwise(F.array_append(s["kept"], p)).alias("kept"), F.when(full, s["used"]).otherwise(s["used"] + F.length(p) + 2).alias("used"), full.alias("full"))

    kept = F.array_join(F.aggregate(F.split(text, "\n\n"), start, step)["kept"], "\n\n")
    kept = F.when(F.length(kept) > cap, F.rtrim(F.left(kept, F.lit(cap)))).otherwise(kept)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(kept, F.lit(" [...]")))


def with_options(question: Column, options: Column) -> Column:
    """The question with a complete block of its options (map of letter to text), one a line.

    A question that has all letters at line starts stays; one with all options inline is cut at the first of them; one
    with some option lines loses their letters; then the block follows. Without options it stays.
    """
    text = F.coalesce(question, F.lit(""))
    own = F.filter(F.array_sort(F.map_entries(options)), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    letters = F.array_distinct(F.transform(own, lambda e: F.upper(F.substring(e["key"], 1, 1))))
    there = F.transform(F.regexp_extract_all(text, F.lit(rf"(?m)^\s*([A-Ja-j])\s*{MARKS}\s*\S"), 1), lambda x: F.upper(x))
    block = F.array_join(F.transform(own, lambda e: F.concat(e["key"], F.lit(". "), F.trim(e["value"]))), "\n")
    pattern = lambda e: F.concat(F.lit("(?s)"), F.upper(F.substring(e["key"], 1, 1)), F.lit(rf"\s*{MARKS}\s*"), quoted(F.trim(e["value"])))
    # Where an option starts, from 1; patterns differ by row.
    places = F.filter(F.transform(own, lambda e: F.regexp_instr(text, pattern(e))), lambda i: i > 0)
    bare = F.when(F.size(there) > 0, F.rtrim(F.regexp_replace(text, rf"(?m)^\s*([A-Ja-j])\s*{MARKS}\s*\S", ""))).otherwise(text)
    cut = F.rtrim(F.left(text, F.array_min(places) - 1))
    joined = lambda head: F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("\n"), block)
    return F.when(F.coalesce(F.size(own), F.lit(0)) < 1, text).when(F.size(F.array_except(letters, there)) == 0, text).when(F.size(places) == F.size(own), joined(cut)).otherwise(joined(bare))
