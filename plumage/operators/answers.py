"""Free-text answers of vision models as candidate rows, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OTHER_ROOT, OTHER_TAG = "其它", "未分类"

_END = r"(?:\n|[；;]|[、，,]|$)"
_CN_END = f"(?={_END}|英文名称|学名|识别准确|中文名称)"

#: How answers name things. Ends of clauses, the subject's clause, labels between commas, and loose forms in the order they are tried.
CLAUSE_ENDS = r"\s*[；;]\s*|\s*\n+"
SUBJECT_CLAUSE = r"^主体类型\s*[:：]\s*(.+)$"
SUBJECT_INLINE = r"主体类型\s*[:：]\s*([^\n；;]+)"
BETWEEN_COMMAS = {"cn": "中文名称|中文名稱", "en": "英文名称", "sci": "学名"}
CLAUSES = {"brief": "简要说明", "animal": "动物名称", "kind": "动物类型", "cn": "中文名称", "en": "英文名称", "sci": "学名"}
LOOSE = {
    "cn": [r"(?s)\*\*中文名称\*\*[:：]\s*\*\*(.+?)\*\*", r"(?s)这只鸟是\*\*(.+?)\*\*", r"(?s)中文名称\**\s*[:：]\s*(.+?)" + _CN_END, f"_+({T.CJK}" + "{1,24})_+"],
    "en": [r"(?s)英文名称\**\s*[:：]\s*(.+?)" + _CN_END, r"_+([A-Z][a-z]{2,})_+"],
    "sci": [r"(?s)\*\*学名\*\*[:：]\s*\*(.+?)\*", r"(?s)学名\**\s*[:：]\s*(.+?)" + _CN_END, r"_+([A-Z][a-z]+(?:\s+[a-z][a-z]+)+)_+"],
}


def _clauses(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, CLAUSE_ENDS), T.stripped), lambda c: c != "")


def _labelled(clauses: Column, label: str, clean) -> Column:
    """The last clause with a label whose cleaned value isn't empty."""
    pattern = f"^{label}" + r"\s*[:：]\s*(.+)$"
    found = F.filter(F.transform(F.filter(clauses, lambda c: c.rlike(pattern)), lambda c: clean(F.regexp_extract(c, pattern, 1))), lambda v: v != "")
    return F.try_element_at(found, F.lit(-1))


def _compact(parts: Column, labels: str, clean) -> Column:
    """The same for parts between commas, of which the label need only be the start."""
    pattern = f"^({labels})[^:：]*[:：](.*)$"
    found = F.filter(F.transform(F.filter(parts, lambda p: p.rlike(pattern)), lambda p: clean(F.regexp_extract(p, pattern, 2))), lambda v: v != "")
    return F.try_element_at(found, F.lit(-1))


def _first_match(value: Column, patterns: list[str], clean) -> Column:
    """The first pattern whose group, cleaned, isn't empty."""
    return F.coalesce(*[F.nullif(clean(F.regexp_extract(value, p, 1)), F.lit("")) for p in patterns])


def parsed(answers: DataFrame, column: str = "answer", longest: int = 8) -> DataFrame:
    """STR10: subject, names and confidence of an answer.

    Labelled clauses come first, then comma-separated labels, then marked-up and
    loose forms. An answer without a percentage has confidence 0.9; a null answer is
    an empty one.
    """
    raw = T.stripped(F.coalesce(F.col(column), F.lit("")))
    df = answers.withColumn("_raw", raw).withColumn("_text", T.without_notes(F.col("_raw")))
    df = df.withColumn("_clauses", _clauses(F.col("_text"))).withColumn("_parts", F.transform(F.split("_text", "[、，,]"), T.stripped))
    squeezed = lambda most: lambda v: F.substring(F.regexp_replace(T.before_next_label(v), r"\s+", ""), 1, most)
    clauses = F.col("_clauses")
    said = F.filter(F.transform(F.filter(clauses, lambda c: c.rlike(SUBJECT_CLAUSE)), lambda c: T.subject(F.regexp_extract(c, SUBJECT_CLAUSE, 1))), lambda s: s.isNotNull())
    inline = F.regexp_extract("_raw", SUBJECT_INLINE, 1)
    cleaned = {"brief": squeezed(80), "animal": squeezed(40), "kind": squeezed(20), "cn": T.cn_name, "en": T.en_name, "sci": T.sci_name}
    named = {"cn": "_cn1", "en": "_en1", "sci": "_sci1"}
    df = df.withColumns({"_subject": F.coalesce(F.try_element_at(said, F.lit(-1)), F.when(inline != "", T.subject(inline)), F.lit("")), **{named.get(k, k): _labelled(clauses, label, cleaned[k]) for k, label in CLAUSES.items()}})
    bare = F.filter(F.transform(F.filter(clauses, lambda c: ~c.rlike("[:：]")), T.cn_name), lambda v: v != "")
    between = lambda k: _compact(F.col("_parts"), BETWEEN_COMMAS[k], cleaned[k])
    loose = lambda k: _first_match(F.col("_text"), LOOSE[k], cleaned[k])
    cn = F.coalesce(between("cn"), "_cn1", "animal", F.get(bare, F.lit(0)), loose("cn"))
    en = F.coalesce(between("en"), "_en1", loose("en"), F.lit(""))
    sci = F.coalesce(between("sci"), "_sci1", loose("sci"), F.lit(""))
    df = df.withColumns({"_cn": F.coalesce(cn, F.lit("")), "en": en, "sci": sci, "confidence": F.coalesce(T.percent(F.col("_raw")), F.lit(0.9))})
    fits = F.col("_cn").rlike(T.CJK) & ~T.implausible_name(F.col("_cn"), longest)
    df = df.withColumn("cn", F.when(fits, F.col("_cn")).otherwise(""))
    any_name = (F.col("cn") != "") | (F.col("en") != "") | (F.col("sci") != "")
    df = df.withColumn("subject", F.when((F.col("_subject") == "") & any_name, "bird").otherwise(F.col("_subject")))
    return df.drop("_raw", "_text", "_clauses", "_parts", "_subject", "_cn1", "_en1", "_sci1", "_cn")


def candidates(answers: DataFrame, longest: int = 8) -> DataFrame:
    """STR11: at most one candidate an answer; rows without one go.

    Subjects other than birds collapse into one archive class. A bird needs a name,
    and a plausible Chinese one if it has one. A confidence of 0 counts as not given.
    """
    df = parsed(answers, longest=longest)
    other = F.col("subject").isin("human", "other_animal", "other")
    label = F.coalesce(F.nullif("cn", F.lit("")), "brief", "animal", F.lit(OTHER_TAG))
    cn = F.when(other, F.when(T.implausible_name(label, longest), "未知").otherwise(label)).otherwise(F.col("cn"))
    given = F.nullif("confidence", F.lit(0.0))
    out = df.withColumns({
        "chinese_name": cn, "scientific_name": F.when(other, "").otherwise(F.col("sci")), "subject_type": F.when(other, "other").otherwise("bird"),
        "conf": F.coalesce(given, F.when(other, 0.85).otherwise(0.9)), "archive_root": F.when(other, OTHER_ROOT), "archive_tag": F.when(other, OTHER_TAG),
    })
    keep = other | (F.col("cn") != "") | (F.col("en") != "") | (F.col("sci") != "")
    return out.filter(keep).select(*answers.columns, "subject_type", "chinese_name", F.col("en").alias("english_name"), "scientific_name", F.col("conf").alias("confidence"), "archive_root", "archive_tag")
