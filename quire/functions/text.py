"""Text rules as Column expressions; Arrow functions only where Catalyst has no match."""

from __future__ import annotations

import html
import unicodedata
from string import Template

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import values

#: White space as Python's strip() has it; (?U) alone leaves the four separators out.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
PLACEHOLDER = r"(?i)\{\s*v([0-9\s]+)\}"


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def drop_control(text: Column) -> Column:
    """Without code points of the Unicode categories C*."""
    return F.regexp_replace(text, r"\p{C}", "")


def drop_control_exact(text: Column) -> Column:
    """The same by Python's Unicode tables, which know later code points."""

    def each(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else "".join(c for c in s if unicodedata.category(c)[0] != "C"))

    return F.pandas_udf(each, "string")(text)


def unescape_basic(text: Column) -> Column:
    """The five basic entities; the ampersand last, so nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape(text: Column) -> Column:
    """All entities."""

    def each(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else html.unescape(s))

    return F.pandas_udf(each, "string")(text)


def truncate(text: Column, chars: int) -> Column:
    """The first code points: 5000 for one service, 1000 for another."""
    return F.substring(text, 1, chars)


def captures(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_capture(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(captures(text, pattern, group), F.lit(1))


def last_capture(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(captures(text, pattern, group), F.lit(-1))


def drop_thought(text: Column) -> Column:
    """Without a leading thought block, to its first end mark."""
    return F.regexp_replace(text, f"(?s){values.THOUGHT}", "")


def drop_thought_tolerant(text: Column) -> Column:
    """Without a leading thought block and the line ends and repeated marks after it."""
    return strip(F.regexp_replace(strip(text), f"(?s){values.THOUGHT_TOLERANT}", ""))


def drop_end_of_turn(text: Column) -> Column:
    return F.replace(text, F.lit("<end_of_turn>"), F.lit(""))


def token_budget(text: Column, least: int = 2000, times: int = 5) -> Column:
    """Tokens that an answer may have: by the row, not by the longest text so far."""
    return F.greatest(F.lit(least), F.length(text) * times)


def too_long(answer: Column, text: Column) -> Column:
    return F.length(answer) > token_budget(text)


def render(template: Column | str, lang_in: Column, lang_out: Column, text: Column) -> Column:
    """${lang_in}, ${lang_out} and ${text} filled in; the text last, as it is not a template."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in (("lang_in", lang_in), ("lang_out", lang_out), ("text", text)):
        out = F.replace(out, F.lit("${" + name + "}"), value)
    return out


def render_exact(template: str, lang_in: Column, lang_out: Column, text: Column) -> Column:
    """With all of the template language: $name, ${name}, $$; unknown names stay."""

    def each(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        t = Template(template)
        return pd.Series([t.safe_substitute(lang_in=x, lang_out=y, text=z) for x, y, z in zip(a, b, c, strict=True)])

    return F.pandas_udf(each, "string")(lang_in, lang_out, text)


#: Used where no template is given.
DEFAULT_TEMPLATE = "Translate from ${lang_in} to ${lang_out}. Answer with the translation alone and leave marks such as {v0} as they stand.\n\n${text}"


def messages(template: str | None, lang_in: Column, lang_out: Column, text: Column) -> Column:
    """What a chat service is sent: one message of the user."""
    said = render(template or DEFAULT_TEMPLATE, lang_in, lang_out, text)
    return F.array(F.struct(F.lit("user").alias("role"), said.alias("content")))


def language_alias(lang: Column, aliases: dict[str, str]) -> Column:
    """A service's own code for a language; others stay as they are."""
    return F.coalesce(F.element_at(_map(aliases), F.lower(lang)), lang) if aliases else lang


def language_word(lang: Column) -> Column:
    """English name of ten languages; any other is an error."""
    return F.coalesce(F.element_at(_map(values.LANGUAGE_WORDS), lang), F.raise_error(F.concat(F.lit("unknown language: "), lang)))


def language_code(name: Column) -> Column:
    return F.element_at(_map(values.LANGUAGE_CODES), name)


def service_registry_name(name: Column) -> Column:
    return F.element_at(_map(values.SERVICE_NAMES), name)


def service_parts(spec: Column) -> Column:
    """Name and model of "name:model"; the model may hold further colons."""
    parts = F.split(spec, ":", 2)
    return F.struct(parts[0].alias("name"), F.try_element_at(parts, F.lit(2)).alias("model"))


def font_file(lang: Column) -> Column:
    fonts = {lang_: values.PAN_SCRIPT_FONT for lang_ in values.PAN_SCRIPT_LANGUAGES}
    fonts |= {lang_: values.region_font(region) for region, langs in values.REGION_LANGUAGES.items() for lang_ in langs}
    return F.coalesce(F.element_at(_map(fonts), F.lower(lang)), F.lit(values.PAN_SCRIPT_FONT))


def line_height(lang: Column) -> Column:
    return F.coalesce(F.element_at(_map(values.LINE_HEIGHTS), F.lower(lang)), F.lit(values.OTHER_LINE_HEIGHT))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def output_names(path: Column, folder: Column | None = None) -> Column:
    """Paths of the translated and the bilingual file: in a folder, or beside the input."""
    place = folder if folder is not None else F.regexp_replace(path, r"/?[^/]*$", "")
    inside = F.when(place == "", F.lit("")).otherwise(F.concat(F.regexp_replace(place, "/$", ""), F.lit("/")))
    return F.struct(F.concat(inside, stem(path), F.lit("-mono.pdf")).alias("mono"), F.concat(inside, stem(path), F.lit("-dual.pdf")).alias("dual"))


def threads(text: Column) -> Column:
    """A number of threads, 1 where the text is no number."""
    return F.coalesce(text.try_cast("int"), F.lit(1))


def number(text: Column) -> Column:
    """A double, or null where the text is none."""
    return text.try_cast("double")


def placeholder(number_: Column) -> Column:
    return F.concat(F.lit("{v"), number_.cast("string"), F.lit("}"))


def rich_text_marks(number_: Column, family: str = "tags") -> Column:
    """Left mark, right mark and formula mark of rich text: tags, or double braces."""
    n = number_.cast("string")
    if family == "tags":
        left, right = F.concat(F.lit("<b"), n, F.lit(">")), F.concat(F.lit("</b"), n, F.lit(">"))
        return F.struct(left.alias("left"), right.alias("right"), F.concat(left, right).alias("formula"))
    left, after = F.concat(F.lit("{{v"), n, F.lit("}}")), F.concat(F.lit("{{v"), (number_ + 1).cast("string"), F.lit("}}"))
    return F.struct(left.alias("left"), after.alias("right"), left.alias("formula"))


def placeholder_numbers(text: Column) -> Column:
    """Numbers of the marks in a text, spaces inside them removed; null where there is none."""
    return F.transform(captures(text, PLACEHOLDER), lambda x: F.regexp_replace(x, r"\s", "").try_cast("int"))


def untranslatable(text: Column) -> Column:
    """Blank, or nothing but one mark."""
    return (strip(text) == "") | text.rlike(r"^\{v[0-9]+\}$")


def masked(label: Column, value: Column, stored: Column | None = None) -> Column:
    """Keys are shown as ***, values that are no model are hidden; *** means the stored key."""
    if stored is not None:
        return F.when(value == "***", stored).otherwise(value)
    return F.when(F.upper(label).contains("API_KEY"), F.lit("***")).otherwise(value)
