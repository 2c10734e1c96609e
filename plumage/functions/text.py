"""Text expressions for names, paths, captions and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the fields in a model's answer.
LABELS = ("主体类型", "简要说明", "动物名称", "英文名称", "学名", "识别准确率", "准确率", "置信度", "中文名称")
#: Tokens that no species name has.
STOP_TOKENS = (
    "主体类型", "简要说明", "动物名称", "英文名称", "中文名称", "学名", "识别准确率", "准确率", "置信度", "图中", "可能是", "无法确定", "看起来", "这只", "该图", "照片",
)
#: Suffixes of administrative names, and what file names can't hold.
ADMIN_SUFFIX = "(维吾尔自治区|壮族自治区|回族自治区|特别行政区|自治区|省|市)$"
UNSAFE = r'[\\/:*?"<>|]'
CJK = r"[一-鿿·・]"


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_name(name: Column) -> Column:
    """STR1."""
    return F.regexp_replace(name, UNSAFE, "_")


def admin_base(name: Column) -> Column:
    """STR2: a region's name without its administrative suffix."""
    return F.trim(F.regexp_replace(F.trim(name), ADMIN_SUFFIX, ""))


def before_next_label(value: Column) -> Column:
    """STR3: the value up to the next field label, trimmed of full stops."""
    cut = F.regexp_replace(value, r"(?s)\s*([；;，,、]\s*)?(" + "|".join(LABELS) + r")\s*[:：].*$", "")
    return F.btrim(stripped(cut), F.lit("。．. "))


def stripped(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, r"^(?U)\s+|(?U)\s+$", "")


def without_notes(value: Column) -> Column:
    """STR4: without bracketed notes."""
    for note in (r"(?s)[（(]\s*注[:：].*?[）)]\s*", r"(?s)[（(]\s*(说明|备注|提示)[:：].*?[）)]\s*", r"[（(]\s*图中[^）)]*[）)]\s*"):
        value = F.regexp_replace(value, note, "")
    return stripped(value)


def without_underscores(value: Column) -> Column:
    """STR5: without underscores around it; those inside stay."""
    return stripped(F.btrim(stripped(value), F.lit("_")))


def without_markdown(value: Column) -> Column:
    """STR5: without asterisks around it, and without bold marks."""
    return stripped(F.replace(F.regexp_replace(stripped(value), r"^\*+\s*|\s*\*+$", ""), F.lit("**"), F.lit("")))


def cn_name(value: Column) -> Column:
    """STR6: a Chinese name out of a fragment, else ''."""

    def unwrapped(clean: Column) -> Column:
        inside = F.regexp_extract(clean, "_+(" + CJK + "{1,24})_+", 1)
        return F.regexp_replace(once(inside, lambda w: F.when(w != "", w).otherwise(without_underscores(clean))), r"(?U)\s+", "")

    def head(name: Column) -> Column:
        return F.when(name.rlike("^" + CJK + "{1,24}$"), name).otherwise(F.regexp_extract(name, "^" + CJK + "{2,24}", 0))

    return once(once(before_next_label(without_markdown(without_notes(value))), unwrapped), head)


def en_name(value: Column) -> Column:
    """STR7: an English name out of a fragment."""
    return stripped(F.regexp_replace(without_underscores(before_next_label(without_markdown(without_notes(value)))), r"\s+", " "))


def sci_name(value: Column) -> Column:
    """STR7: a scientific name out of a fragment, up to the first bracket."""
    clean = without_underscores(stripped(F.replace(before_next_label(without_markdown(without_notes(value))), F.lit("*"), F.lit(""))))
    return stripped(F.substring_index(clean, "(", 1))


def percent(value: Column) -> Column:
    """STR8: the first percentage as a share, null if there is none from 0 to 100."""
    n = F.regexp_extract(value, r"(\d{1,3})\s*%", 1).try_cast("int")
    return F.when(n.between(0, 100), n / 100.0)


def subject(value: Column) -> Column:
    """STR9: what a subject token means: bird, human, other_animal, other or ''."""

    def meaning(v: Column) -> Column:
        return (
            F.when(v.isin("鸟类", "鸟"), "bird").when(v.isin("人像", "人物", "人"), "human").when(v.isin("其它动物", "其他动物", "动物"), "other_animal").when(v.isin("其它", "其他"), "other")
            .when(v.contains("鸟") & (F.length(v) <= 4), "bird").when(v.contains("人像"), "human").when(v.contains("动物"), "other_animal").otherwise("")
        )

    return once(F.rtrim(stripped(value), F.lit("。；;，,、")), meaning)


def implausible_name(value: Column, most: int = 24) -> Column:
    """FLT13: too long, punctuated, or with words of an explanation."""
    found = lambda s: (s != "") & ((F.length(s) > most) | s.rlike(r"[\n\r:：;；,，。.!?？（）()]") | s.rlike("|".join(STOP_TOKENS)))
    return once(stripped(F.coalesce(value, F.lit(""))), found)


def chat_text(body: Column) -> Column:
    """STR12: the assistant's text of a chat answer (JSON text), else of the older shape, else ''."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "output_text")), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    chat = stripped(F.when(content.startswith("["), joined).otherwise(content))
    output = F.from_json(F.get_json_object(body, "$.output"), "array<struct<type:string,role:string,content:array<struct<type:string,text:string>>>>")
    texts = F.flatten(F.transform(F.filter(output, lambda o: (o["type"] == "message") & (o["role"] == "assistant")), lambda o: F.filter(o["content"], lambda c: c["type"] == "output_text")))
    older = stripped(F.get(texts, F.lit(0))["text"])
    return F.coalesce(F.nullif(chat, F.lit("")), F.nullif(older, F.lit("")), F.lit(""))


def prompt(template: str, region: Column, most: int) -> Column:
    """STR13: a request text with the region's hint and the longest name allowed."""
    return F.format_string(template, F.coalesce(F.nullif(region, F.lit("")), F.lit("中国")), F.lit(most))


def unquoted(value: Column) -> Column:
    """STR15."""
    return F.btrim(F.btrim(F.trim(value), F.lit('"')), F.lit("'"))


def padded_number(n: Column, digits: int = 5) -> Column:
    """Digits with zeros in front; longer numbers keep all of theirs."""
    text = n.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path's last part, with its dot; '' if none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def caption(*parts: Column, default: str = "") -> Column:
    """PRJ10: the non-empty parts with bars between."""
    found = F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(found) == 0, F.lit(default)).otherwise(F.array_join(found, "  |  "))


def camera_line(model: Column, f_number: Column, exposure: Column, focal: Column, iso: Column) -> Column:
    """SRC18: camera facts in one line; absent ones are skipped. Rationals are structs (num, den)."""
    ratio = lambda r: r["num"] / F.nullif(r["den"], F.lit(0))
    v = ratio(exposure)
    parts = [
        F.nullif(F.trim(model), F.lit("")), F.format_string("f/%.1f", ratio(f_number)),
        F.when(v < 1, F.concat(F.lit("1/"), F.bround(1 / F.greatest(v, F.lit(1e-6))).cast("long").cast("string"), F.lit("s"))).otherwise(F.format_string("%.1fs", v)),
        F.concat(F.bround(ratio(focal)).cast("long").cast("string"), F.lit("mm")), F.concat(F.lit("ISO"), F.nullif(iso, F.lit(0)).cast("string")),
    ]
    guards = [parts[0], ratio(f_number), v, ratio(focal), iso]
    return F.concat_ws("  ", *[F.when(g.isNotNull(), p) for g, p in zip(guards, parts, strict=True)])


def parent_name(path: Column, root: str) -> Column:
    """PRJ11: the last folder of a path below ``root``, '未知' if none."""
    rel = F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")
    return F.coalesce(F.nullif(F.try_element_at(F.split(rel, "/"), F.lit(-2)), F.lit("")), F.lit("未知"))


def distinct_names(text: Column) -> Column:
    """AGG15: names between commas, semicolons or lines: trimmed, blanks dropped, first kept."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,;\n]"), lambda x: F.trim(x)), lambda x: x != ""))
