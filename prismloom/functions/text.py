"""Parsing and cleaning of model outputs and captions, as Column expressions.

``(?U)`` makes Java's classes Unicode-aware, so that blanks of other scripts are
stripped as well.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: output formats of the judges ------------------------------------
SCORE_REASON = r"(?U)^\s*(\d{1,2})\s*@\s*(.+?)\s*$"
FENCE = r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
#: Style words that a content caption must not hold, as patterns, in the order they are removed.
STYLE_TERMS = (
    "二次元", "动漫", "漫画风", "漫画", "插画", "插图", "水彩", "油画", "丙烯", "素描", "速写", "线稿", "线描", "国画", "泼墨", "像素风",
    "赛博朋克", "蒸汽波", "低多边形", "渲染", "CG", "3D", "3D渲染", "次世代", "卡通", "写实风", "电影感", "胶片感", "赛璐璐", "上色",
    "赛璐璐上色", "喷枪", "版画", "水墨", "扁平风", "抽象风", "风格化", "风格", "画风", "anime", "manga", "cartoon", "illustration",
    "watercolor", r"oil\s*paint(?:ing)?", "sketch", r"line\s*art", "ink", "charcoal", "pastel", r"pixel\s*art", r"low\s*poly", "render",
    "3d", "cgi", "stylized", r"digital\s*art", r"concept\s*art", r"matte\s*painting", "cinematic", r"film\s*grain", "bokeh",
)
IMAGE_URLS = ((r"!\[[^\]]*\]\(([^)]+)\)", 1), (r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+", 0), (r"https?://\S+\.(?:png|jpg|jpeg|webp)", 0))
# ------------------------------------------------------------------------------------


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def first_sentence(col: Column) -> Column:
    """Text before the first full stop, stripped; null becomes ''."""
    return strip(F.substring_index(F.coalesce(col, F.lit("")), ".", 1))


def unfence(col: Column) -> Column:
    """Content of a fenced block, or the text as it is."""
    inner = F.regexp_extract(col, FENCE, 1)
    return F.when(col.rlike(FENCE), inner).otherwise(col)


def unfence_lines(col: Column) -> Column:
    """Text without its first and last line where it starts with a fence."""
    body = F.regexp_replace(F.regexp_replace(strip(col), r"^```[^\n]*\n", ""), r"\n[^\n]*$", "")
    return F.when(strip(col).startswith("```"), strip(body)).otherwise(strip(col))


def _clamped(value: Column) -> Column:
    # greatest and least skip nulls, so a null must be kept apart
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), value)))


def score_and_reason(col: Column) -> Column:
    """struct<score int, reason string> of ``score@reason``; the first line counts, the score is
    kept within 0..10. JSON with OVERALL.score and OVERALL.reason is read as well. Null when neither fits."""
    text = unfence(col)
    line = F.substring_index(strip(text), "\n", 1)
    plain = F.struct(_clamped(F.regexp_extract(line, SCORE_REASON, 1).try_cast("int")).alias("score"), F.regexp_extract(line, SCORE_REASON, 2).alias("reason"))
    number = F.get_json_object(text, "$.OVERALL.score").try_cast("double").cast("int")
    why = F.get_json_object(text, "$.OVERALL.reason")
    json = F.struct(_clamped(number).alias("score"), strip(F.coalesce(why, F.lit(""))).alias("reason"))
    return F.when(line.rlike(SCORE_REASON), plain).when(number.isNotNull() & (F.length(strip(F.coalesce(why, F.lit("")))) > 0), json)


def float_score(col: Column) -> Column:
    """Number before the first ``@``, within 0..10; null where it is no finite number."""
    head = strip(F.substring_index(col, "@", 1))
    number = F.when(head.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), head.try_cast("double"))
    return F.when(col.contains("@") & number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)))


def label_pair(col: Column) -> Column:
    """struct<common string, label int> of a COMMON/LABEL answer in two lines or JSON. A label 0 is kept."""
    text = unfence(col)
    common = F.regexp_extract(text, r"(?im)^\s*COMMON\s*[:：]\s*(.*?)\s*$", 1)
    label = F.regexp_extract(text, r"(?im)^\s*LABEL\s*[:：]\s*([01])", 1)
    j_label = F.coalesce(F.get_json_object(text, "$.label"), F.get_json_object(text, "$.LABEL"))
    j_common = F.coalesce(F.get_json_object(text, "$.common"), F.get_json_object(text, "$.COMMON"), F.lit(""))
    return F.when(label != "", F.struct(common.alias("common"), label.cast("int").alias("label"))).when(j_label.isin("0", "1"), F.struct(j_common.alias("common"), j_label.cast("int").alias("label")))


def extract_json(col: Column) -> Column:
    """JSON object of a text: the whole, else a fenced block, else from the first { to the last }; else null."""
    whole = strip(col)
    fenced = F.regexp_extract(col, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(col, r"(?s)(\{.*\})", 1)

    def valid(text: Column) -> Column:
        return F.when(F.try_parse_json(F.nullif(text, F.lit(""))).isNotNull(), text)

    return F.coalesce(valid(whole), valid(fenced), valid(braces))


def scenario(col: Column, language: str) -> Column:
    """A language's field of a bilingual answer, or the raw text where there is none."""
    found = F.get_json_object(extract_json(col), f"$.{language}")
    return F.coalesce(F.nullif(strip(found), F.lit("")), strip(col))


def compose_prompt(fields: list[Column], original: Column) -> Column:
    """Non-null fields joined by ', '; the original where all are null."""
    return F.coalesce(F.nullif(F.concat_ws(", ", *fields), F.lit("")), original)


def with_style(prompt: Column, instruction: str) -> Column:
    """Prompt and style instruction, with a full stop between where the prompt ends without one."""
    base = strip(prompt)
    return F.concat(base, F.when(base.rlike(r"[.!?]$"), F.lit(" ")).otherwise(F.lit(". ")), F.lit(instruction))


def pick_prompts(raw: Column) -> Column:
    """Prompts of a JSON list, or of a JSON object in the order of its keys; blanks are dropped."""
    as_list = F.from_json(raw, "array<string>")
    as_map = F.from_json(raw, "map<string,string>")
    values = F.transform(F.array_sort(F.map_entries(as_map)), lambda e: e["value"])
    chosen = F.when(F.ltrim(raw).startswith("["), as_list).when(F.ltrim(raw).startswith("{"), values)
    return F.filter(chosen, lambda p: p.isNotNull() & (F.length(strip(p)) > 0))


def pair_parts(key: Column) -> tuple[Column, Column]:
    """Content and style of a pair key ``c__s``; the style is '' where there is none."""
    return F.split_part(key, F.lit("__"), F.lit(1)), F.split_part(key, F.lit("__"), F.lit(2))


def canonical_json(col: Column) -> Column:
    """JSON with sorted keys, without blanks, in plain Unicode; null where it cannot be parsed. In Arrow batches."""
    @F.pandas_udf("string")
    def dump(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return dump(col)


def path_stem(col: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(col, r"([^/]*)$", 1), r"\.[^.]*$", "")


def path_extension(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"(\.[^./]+)$", 1))


def minimum_pixels(message: Column) -> Column:
    """The number a 'must be at least' message asks for."""
    return F.regexp_extract(message, r"(?s)image size must be at least \D*(\d+)", 1).try_cast("int")


def image_urls(col: Column) -> Column:
    """Markdown images, data URIs and plain image links, each once in that order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(col, F.lit(p), F.lit(group)) for p, group in IMAGE_URLS]))


def clean_caption(col: Column, terms: tuple[str, ...] = STYLE_TERMS, longest: int = 240) -> Column:
    """A content caption without quotes at its ends and without style words (each with a
    following 风), its words parted by single blanks and its marks followed by one, at most
    ``longest`` characters. Where no word is left the caption as it came, '' for null.

    The words are taken as tokens: one pattern removes all style terms, longer ones first, one splits
    at blanks, and joining the tokens gives the spacing."""
    given = F.trim(F.coalesce(col, F.lit("")))
    by_length = sorted(terms, key=len, reverse=True)
    bare = F.regexp_replace(given, f"(?iU)({'|'.join(by_length)})\\s*风?格?", " ")
    tokens = F.filter(F.split(F.regexp_replace(bare, r"([,.;:!?])", "$1 "), r"(?U)\s+"), lambda t: t != "")
    line = F.array_join(tokens, " ")
    tight = F.regexp_replace(F.regexp_replace(line, " (?=[,.;:!?])", ""), "^[\"'`‘’“” ]+|[\"'`‘’“” ]+$", "")
    short = F.when(F.length(tight) > longest, F.rtrim(F.left(tight, F.lit(longest)), F.lit(" ,.;:!?"))).otherwise(tight)
    return F.when(short.rlike(r"[\p{L}\p{N}]"), short).otherwise(strip(F.coalesce(col, F.lit(""))))


def cyclic_sentence(caption: Column, sentences: list[str], position: Column) -> Column:
    """Caption and the sentence whose turn it is."""
    turn = F.element_at(F.array(*[F.lit(s) for s in sentences]), (F.pmod(position, F.lit(len(sentences))) + 1).cast("int"))
    return F.concat_ws(" ", caption, turn)


def natural_order(index: Column) -> list[Column]:
    """Sort keys: named indexes by their trailing number, then those without one by text, missing last."""
    number = F.regexp_extract(index, r"(\d+)$", 1).try_cast("bigint")
    missing = index.isNull() | (index == "")
    return [missing.cast("int").asc(), F.coalesce(number.cast("double"), F.lit(float("inf"))).asc(), index.asc_nulls_last()]


def numeric_first(key: Column) -> list[Column]:
    """Sort keys: the first run of digits as a number; keys without digits last, by text."""
    number = F.regexp_extract(key, r"(\d+)", 1).try_cast("bigint")
    return [number.isNull().asc(), number.asc(), key.asc()]


def truth_text(value: str) -> bool:
    """Flag texts of a command line."""
    text = value.strip().lower()
    if text in {"1", "true", "yes", "y", "on"}:
        return True
    if text in {"0", "false", "no", "n", "off"}:
        return False
    raise ValueError(f"no truth value: {value!r}")


def role_of_column(name: str) -> str:
    """``image_id`` names the role ``image``."""
    return name.removesuffix("_id")
