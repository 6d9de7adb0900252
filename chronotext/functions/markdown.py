"""Markdown and prompt text as columns: fences, front matter, math delimiters, front matter blocks, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_front_matter(text: Column) -> Column:
    """The text behind a leading block between lines of three dashes."""
    return F.regexp_replace(text, r"(?s)\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def without_fence(text: Column) -> Column:
    """The inside of a fence that wraps the whole text; other fences stay."""
    inner = F.regexp_extract(F.trim(text), r"(?s)\A```[A-Za-z]*[ \t]*\r?\n(.*)\r?\n```\z", 1)
    whole = F.rlike(F.trim(text), F.lit(r"(?s)\A```[A-Za-z]*[ \t]*\r?\n.*\r?\n```\z"))
    # a wrapper has no line that closes a fence inside and leaves an odd one behind
    even = F.size(F.filter(F.split(inner, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("```")))) % 2 == 0
    return F.when(whole & even, inner).otherwise(text)


def without_json_fence(text: Column) -> Column:
    """The trimmed text, without the one fence of three backticks (or with ``json`` behind them) that may stand around it; other fences stay."""
    own = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    inner = F.regexp_extract(own, r"(?is)\A```(?:json)?[ \t]*\r?\n(.*)\r?\n[ \t]*```[^\r\n]*\z", 1)
    fenced = F.rlike(own, F.lit(r"(?is)\A```(?:json)?[ \t]*\r?\n.*\r?\n[ \t]*```[^\r\n]*\z"))
    return F.when(fenced, F.regexp_replace(inner, r"(?U)\A\s+|\s+\z", "")).otherwise(own)


def dollar_math(text: Column) -> Column:
    r"""\( \) and \[ \] as dollars, line by line and not inside code fences (a fold, as a fence is opened and closed)."""
    start = F.struct(F.lit(False).alias("code"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, line: Column) -> Column:
        fence = F.startswith(F.ltrim(line), F.lit("```"))
        plain = F.regexp_replace(F.regexp_replace(line, r"\\\(\s*(.*?)\s*\\\)", r"\$$1\$"), r"\\[\[\]]", r"\$\$")
        return F.struct((a["code"] != fence).alias("code"), F.concat(a["out"], F.array(F.when(a["code"] | fence, line).otherwise(plain))).alias("out"))

    return F.array_join(F.aggregate(F.split(text, "\n"), start, step, lambda a: a["out"]), "\n")


def front_matter(**fields: Column) -> Column:
    """A YAML block of the fields that aren't null, values quoted."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f'{k}: "'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def rendered(template: str, **values: Column) -> Column:
    """The template with {{NAME}} replaced; null where a placeholder has no value."""
    out = F.lit(template)
    for k, c in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), c)
    return F.when(~F.rlike(out, F.lit(r"\{\{[A-Z_]+\}\}")), out)


def glossary_block(terms: Column) -> Column:
    """The terms of a prompt in one line."""
    return F.when(F.size(terms) > 0, F.array_join(terms, "、")).otherwise("（无）")


def indented_json(rows: Column, fields: list[str]) -> Column:
    """A list of flat structs as JSON, a field a line, indented by two."""
    value = lambda x, f: F.coalesce(F.substring(F.to_json(F.array(x[f])), F.lit(2), F.length(F.to_json(F.array(x[f]))) - 2), F.lit("null"))
    one = lambda x: F.concat(F.lit("  {\n"), F.concat_ws(",\n", *(F.concat(F.lit(f'    "{f}": '), value(x, f)) for f in fields)), F.lit("\n  }"))
    return F.when(F.size(rows) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(rows, one), ",\n"), F.lit("\n]"))).otherwise("[]")


def filled(template: Column, **values: Column) -> Column:
    """The template with {{name}} replaced by the values, one name after the other; null where a placeholder is left."""
    out = template
    for k, c in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), c)
    return F.when(~F.rlike(out, F.lit(r"\{\{[a-z_]+\}\}")), out)


def clean_prompt(template: Column, mode: Column, course_name: Column, terms: Column, segments: Column, fields: list[str], boundary_context: Column) -> Column:
    """The prompt for a chunk of segments."""
    context = F.coalesce(F.nullif(boundary_context, F.lit("")), F.lit("无"))
    return filled(template, mode=mode, course_name=course_name, glossary=glossary_block(terms), segments_json=indented_json(segments, fields), boundary_context=context)
