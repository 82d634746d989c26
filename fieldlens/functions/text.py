"""Text normalisation, reason classification and identifier functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value.
NULL_WORDS = ("", "nan", "none", "null")

#: Reason codes in display order.
REASON_CODES = ("EVENT_TOO_SMALL", "YEAR_MISMATCH", "NO_PRE", "NO_POST", "QC_FAILED", "NO_VISIBLE_CHANGE", "OTHER_INVALID")

#: Words of the single-label classifier; the first group with a word in the text wins.
GROUP_WORDS = (
    ("YEAR_MISMATCH", ("прошлого года", "другого года", "следующего года", "год события", "для следующего года", "year mismatch", "wrong year", "last year", "previous year", "next year", "next yea", "another year", "other year", "different year")),
    ("NO_VISIBLE_CHANGE", ("изменений не видно", "не видно разницы", "не видно рвзницы", "no visible change", "no change")),
    ("EVENT_TOO_SMALL", ("маленьк", "небольш", "слишком мал", "small event", "too small")),
    ("TYPE_UNCLEAR", ("невозможно определить", "невозможно понять", "сложно определить", "сложно понять", "не понятно", "непонятно", "type unclear", "unclear")),
    ("QC_FAILED", ("нет валидных изображений", "нет ни одного валидного снимка", "no valid", "qc", "cloud", "облак", "no data")),
)
#: Words for missing images, in the single-label classifier and in the mapping of older texts.
GROUP_MISSING, CODE_MISSING = ("нет", "no ", "missing", "отсутств"), ("no ", "нет ", "отсутств")
#: Words of the mapping of older texts to codes.
CODE_VALID = ("valid", "валидн")
CODE_SMALL = ("small event", "small change", "small damage", "маленьк", "небольш", "слишком мал")
CODE_YEAR = ("next yea", "last year", "other year", "different year", "year's", "другого года", "прошлого года", "прошлогоо года", "следующего года", "неправильно определен год", "не правильно определен год")
CODE_AFTER = ("post", "consequence", "последств")
CODE_BLIND = ("разниц", "рвзниц")
CODE_OTHER = ("both models made a mistake", "явно не пожар, но может и не вырубка - слишком маленькое событие")
#: Words that say which other year is meant.
EARLIER, LATER, ANOTHER = ("прошл", "previous", "prior year"), ("следующ", "next year"), ("другого года", "wrong year", "year mismatch")


def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form (NFKC) is one other character of ASCII or Cyrillic, and these forms."""
    pairs = [(c, k) for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x20000))) if len(k := unicodedata.normalize("NFKC", c)) == 1 and k != c and (k < "\x7f" or "\u0400" <= k <= "\u04ff")]
    return "".join(c for c, _ in pairs), "".join(k for _, k in pairs)


def clean_text(c: Column) -> Column:
    """Trimmed text; words for a missing value are null."""
    t = F.trim(c)
    return F.when(F.lower(t).isin(*NULL_WORDS), None).otherwise(t)


def parse_float(c: Column) -> Column:
    """A finite number, with point or comma; anything else is null."""
    v = F.replace(clean_text(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def parse_int(c: Column) -> Column:
    """The whole part of a number."""
    return parse_float(c).cast("long")


def parse_event_year(c: Column) -> Column:
    """A year from 1980 to 2100, else null."""
    v = parse_int(c)
    return F.when(v.between(1980, 2100), v.cast("int"))


def parse_bool(c: Column) -> Column:
    """true/yes/1 and false/no/0 in any case, else null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def fold(c: Column) -> Column:
    """Lower case, the letter yo as ye, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), r"\s+", " "))


def has_any(t: Column, words: Iterable[str]) -> Column:
    """Whether the text holds one of the words, anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def reason_group(c: Column) -> Column:
    """One group for a free-text reason: missing images before the event, then the first group with a word in it (a year of four digits counts as one of YEAR_MISMATCH), else OTHER_INVALID; so is blank."""
    t = fold(c)
    out = F.when(t == "", "OTHER_INVALID").when(t.contains("pre") & has_any(t, GROUP_MISSING), "NO_PRE")
    for group, words in GROUP_WORDS:
        hit = has_any(t, words)
        out = out.when(hit | t.rlike(r"(?U)\b(?:19|20)\d{2}\b") if group == "YEAR_MISMATCH" else hit, group)
    return out.otherwise("OTHER_INVALID")


def compatible_fold(c: Column) -> Column:
    """Fold over compatibility forms: full-width and other variants of a character count as the character."""
    return F.replace(fold(F.translate(c, *_compatible())), F.lit("’"), F.lit("'"))


def reason_codes(c: Column) -> Column:
    """All codes that an older free text stands for, in display order; none is an empty array.

    Images said to be missing are NO_PRE or NO_POST; said to be there but not valid, QC_FAILED.
    """
    t = compatible_fold(c)
    pre, post = t.rlike(r"(?U)\bpre\b"), t.rlike(r"(?U)\bpost\b")
    missing, valid, unseen = has_any(t, CODE_MISSING), has_any(t, CODE_VALID), t.contains("не видно")
    hits = {
        "EVENT_TOO_SMALL": has_any(t, CODE_SMALL),
        "YEAR_MISMATCH": has_any(t, CODE_YEAR) | (t.rlike(r"(?U)\b20\d{2}\b") & has_any(t, CODE_AFTER)),
        "NO_PRE": pre & missing & ~valid,
        "NO_POST": post & missing & ~valid,
        "QC_FAILED": ((pre | post) & missing & valid) | t.contains("low vegetation") | (valid & ~pre & ~post & t.contains("сним")),
        "NO_VISIBLE_CHANGE": (t.contains("изменен") & unseen) | (unseen & has_any(t, CODE_BLIND)) | t.contains("no visible change"),
        "OTHER_INVALID": t.isin(*CODE_OTHER),
    }
    return F.array_compact(F.array(*(F.when(hits[code], code) for code in REASON_CODES)))


def mapping_status(codes: Column) -> Column:
    """UNMAPPED, MAPPED or MAPPED_MULTI for an array of codes."""
    return F.when(F.size(codes) == 0, "UNMAPPED").when(F.size(codes) == 1, "MAPPED").otherwise("MAPPED_MULTI")


def normalize_codes(codes: Column, canonical: tuple[str, ...] = REASON_CODES) -> Column:
    """Upper-cased, trimmed, distinct, unknown ones dropped, in canonical order."""
    return F.array_intersect(F.array(*(F.lit(c) for c in canonical)), F.transform(codes, lambda x: F.upper(F.trim(x))))


def inferred_year(reason: Column, year: Column) -> Column:
    """struct(year, offset, source): the first 20xx year stated, else the year before or after, else unknown, with or without the word that it is another one."""
    t = F.lower(F.coalesce(reason, F.lit("")))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    stated = F.regexp_extract(t, r"(?U)\b(20\d{2})\b", 1).try_cast("int")

    def found(y: Column, offset: Column, source: str) -> Column:
        return F.struct(y.cast("int").alias("year"), offset.cast("int").alias("offset"), F.lit(source).alias("source"))

    return (
        F.when(stated.isNotNull(), found(stated, stated - year, "explicit_year_in_free_text"))
        .when(has_any(t, EARLIER), found(year - 1, F.lit(-1), "relative_year_in_free_text"))
        .when(has_any(t, LATER), found(year + 1, F.lit(1), "relative_year_in_free_text"))
        .when(has_any(t, ANOTHER), found(F.lit(None), F.lit(None), "different_year_without_direction"))
        .otherwise(found(F.lit(None), F.lit(None), "expert_year_not_structured"))
    )


def stable_id(*parts: Column) -> Column:
    """sha1 of the parts joined by |."""
    return F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


def row_hash(c: Column) -> Column:
    """First 12 hex digits of a text's sha1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


def safe_name(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay; other runs become one underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def append_note(local: Column, incoming: Column, separator: str = " | ") -> Column:
    """Keeps, replaces a blank, skips what is contained already, else appends."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(incoming), local).when(blank(local), incoming).when(local.contains(incoming), local).otherwise(F.concat(local, F.lit(separator), incoming))


def values_equal(a: Column, b: Column) -> Column:
    """Equal texts, where null and blank are the same."""
    return F.coalesce(F.trim(a), F.lit("")) == F.coalesce(F.trim(b), F.lit(""))


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal within the tolerance; two nulls are equal."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def cohort(c: Column) -> Column:
    """Cohort of a manual validation word."""
    t = F.lower(F.trim(c))
    return F.when(t.isNull() | (t == ""), "NO_MANUAL_WEAK").when(t == "valid", "MANUAL_VALID").when(t == "wrong", "MANUAL_WRONG").when(t == "unclear", "MANUAL_UNCLEAR").when(t == "too old", "MANUAL_TOO_OLD").otherwise(F.concat(F.lit("MANUAL_OTHER:"), t))


def agreement(a: Column, b: Column, confidence_a: Column | None = None, confidence_b: Column | None = None) -> Column:
    """AGREE_x, A_x_B_y, UNCERTAIN (a confidence below one half) or INCOMPLETE."""
    out = F.when(a.isNull() | b.isNull(), "INCOMPLETE")
    if confidence_a is not None and confidence_b is not None:
        out = out.when((confidence_a < 0.5) | (confidence_b < 0.5), "UNCERTAIN")
    return out.when(a == b, F.concat(F.lit("AGREE_"), F.upper(a))).otherwise(F.concat(F.lit("A_"), F.upper(a), F.lit("_B_"), F.upper(b)))


def relative_path(c: Column, markers: tuple[str, ...] = ("scripts/researchtool/", "data/", "cache/")) -> Column:
    """The path from its first known folder on, with forward slashes; other absolute paths are null."""
    t = F.replace(c, F.lit("\\"), F.lit("/"))
    out = F.when(t.isNull() | (F.trim(t) == ""), None).when(~t.rlike(r"^(/|[A-Za-z]:)"), t)
    for m in markers:
        at = F.locate("/" + m, F.lower(t))
        out = out.when(at > 0, F.substring(t, at + 1, F.length(t)))
    return out


def path_action(c: Column) -> Column:
    """struct(action, reason) of a stored path's repair."""
    rel = relative_path(c)
    s = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    return (
        F.when(c.isNull() | (F.trim(c) == ""), s("skip", "empty"))
        .when(rel.isNull(), s("report_only", "absolute_outside_project"))
        .when(rel == c, s("skip", "already_relative"))
        .otherwise(s("would_update", "made_relative"))
    )


def quality_flags(value: Column) -> Column:
    """The set of flags in a JSON value, sorted: items of a list; keys of an object whose value is true, not empty and not 0, or the items of a list below a key; a scalar itself. Blank, null and broken values are empty.

    Texts "true" and "false" below a key count as the truth values.
    """
    t = F.trim(value)
    items = lambda c: F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    pairs = F.map_entries(F.from_json(t, "map<string,string>"))
    empty = F.array().cast("array<string>")
    of_key = lambda e: F.when(e["value"].startswith("["), items(e["value"])).when(e["value"].isNull() | e["value"].isin("", "false", "null") | F.coalesce(e["value"].try_cast("double") == 0, F.lit(False)), empty).otherwise(F.array(e["key"]))
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
    found = F.when(t.startswith("["), items(t)).when(t.startswith("{"), F.flatten(F.transform(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")), of_key))).when(F.trim(scalar) != "", F.array(scalar))
    return F.array_sort(F.array_distinct(F.coalesce(found, empty)))
