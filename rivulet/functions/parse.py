"""Reading what models and caption files hold: fenced and broken JSON, caption styles and dialogue, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a style line and of a dialogue line, in the format's order.
STYLE_FIELDS = ["Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "OutlineColour", "BackColour", "Bold", "Italic", "Underline", "StrikeOut", "ScaleX", "ScaleY", "Spacing", "Angle", "BorderStyle", "Outline", "Shadow", "Alignment", "MarginL", "MarginR", "MarginV", "Encoding"]
DIALOGUE_FIELDS = ["Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text"]
#: A quoted string (also one that never ends), or what stands between two.
_PIECES = r'("(?:[^"\\]|\\[\s\S])*+"?|[^"]++)'


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unfenced(text: Column) -> Column:
    """Without the code fence around an answer: the first line if it opens one, and closing backticks."""
    t = stripped(text)
    opened = t.startswith("```")
    cut = F.when(t.contains("\n"), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(F.substring(t, F.lit(4), F.length(t)))
    t = F.when(opened, cut).otherwise(t)
    return stripped(F.regexp_replace(t, "```$", ""))


def corrections(answer: Column, expected: Column) -> Column:
    """The strings of an answer that is a JSON array of that many, else null."""
    found = F.from_json(unfenced(answer), "array<string>")
    whole = F.try_parse_json(unfenced(answer)).isNotNull()
    return F.when(whole & (F.size(found) == expected), found)


def translations(answer: Column) -> Column:
    """The elements of an answer that is a JSON array, else null."""
    return F.when(F.try_parse_json(unfenced(answer)).isNotNull(), F.from_json(unfenced(answer), "array<string>"))


def escaped_breaks(text: Column) -> Column:
    """JSON whose strings hold raw line breaks and tabs, with those escaped; what a backslash precedes stays."""

    def mended(piece: Column) -> Column:
        for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
            piece = F.regexp_replace(piece, rf"\G((?:[^\\{raw}]|\\[\s\S])*+){raw}", rf"$1\\{name}")
        return piece

    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"'), mended(p)).otherwise(p)), "")


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<(?:think|reasoning)>.*?</(?:think|reasoning)>", "")


def json_text(raw: Column) -> Column:
    """The JSON object of a model's answer: thoughts and fences gone, then the text itself, the part between the outer
    braces, or that with its line breaks escaped, whichever parses first; null if none does."""
    t = stripped(without_thoughts(stripped(raw)))
    t = stripped(F.regexp_replace(t, r"(?s)<(?:think|reasoning)>.*?(?=\{)", ""))
    fenced = stripped(F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", ""))
    t = F.when(t.startswith("```") & t.contains("\n"), fenced).otherwise(t)
    outer = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    tries = [t, outer, escaped_breaks(outer)]
    return F.coalesce(*[F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in tries])


def partial_objects(raw: Column) -> Column:
    """The complete objects of a ``clips`` array that may break off: JSON texts, those that don't parse left out."""
    rest = F.regexp_extract(without_thoughts(raw), r'(?s)"clips"\s*:\s*\[(.*)$', 1)
    pieces = F.regexp_extract_all(rest, F.lit(r"([^{}\]]*[{}\]])"), F.lit(1))
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("depth"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        end = F.right(p, F.lit(1))
        opens, closes = end == "{", end == "}"
        inside = s["depth"] > 0
        held = F.when(inside, F.concat(s["held"], p)).when(opens, F.lit("{")).otherwise(F.lit(""))
        done = inside & closes & (s["depth"] == 1)
        depth = F.when(opens, s["depth"] + 1).when(closes & inside, s["depth"] - 1).otherwise(s["depth"])
        over = s["over"] | ((end == "]") & ~inside)
        return F.when(s["over"], s).otherwise(F.struct(F.when(done, F.lit("")).otherwise(held).alias("held"), depth.alias("depth"), over.alias("over"), F.when(done, F.concat(s["found"], F.array(held))).otherwise(s["found"]).alias("found")))

    found = F.transform(F.aggregate(pieces, start, step)["found"], escaped_breaks)
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def style_lines(content: Column) -> Column:
    """Array of maps, one for every ``Style:`` line with all fields."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.startswith("Style:"))
    parts = F.transform(lines, lambda x: F.split(stripped(F.substring(x, F.lit(7), F.length(x))), ","))
    full = F.filter(parts, lambda p: F.size(p) >= len(STYLE_FIELDS))
    names = F.array(*map(F.lit, STYLE_FIELDS))
    return F.transform(full, lambda p: F.map_from_arrays(names, F.transform(F.slice(p, 1, len(STYLE_FIELDS)), stripped)))


def dialogue_lines(content: Column) -> Column:
    """Array of structs, one for every ``Dialogue:`` line; the text keeps its commas and blanks."""
    n = len(DIALOGUE_FIELDS)
    lines = F.filter(F.split(content, "\n"), lambda x: x.startswith("Dialogue:"))
    parts = F.transform(lines, lambda x: F.split(stripped(F.substring(x, F.lit(10), F.length(x))), ",", n))
    full = F.filter(parts, lambda p: F.size(p) >= n)
    return F.transform(full, lambda p: F.struct(*[(stripped(F.get(p, F.lit(i))) if i < n - 1 else F.get(p, F.lit(i))).alias(name) for i, name in enumerate(DIALOGUE_FIELDS)]))


def tempo_chain(speed: Column) -> Column:
    """A speed as a chain of factors within [0.5, 2], as filter text. The number of doublings or halvings is found by
    comparison with the powers of two."""
    up = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda n, i: n + (speed > F.pow(F.lit(2.0), i)).cast("int"))
    down = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda n, i: n + (speed < F.pow(F.lit(2.0), -i)).cast("int"))
    rest = speed * F.pow(F.lit(2.0), down - up)
    parts = F.concat(F.array_repeat(F.lit("atempo=2.0"), up), F.array_repeat(F.lit("atempo=0.5"), down), F.when(F.abs(rest - 1.0) > 0.001, F.array(F.format_string("atempo=%.4f", rest))).otherwise(F.array().cast("array<string>")))
    return F.array_join(parts, ",")


def real_summary(overview: Column, topics: Column, placeholder) -> Column:
    """An overview of twenty characters and more that is no placeholder, and a topic that is none."""
    return ~placeholder(overview) & (F.length(stripped(overview)) >= 20) & F.exists(F.coalesce(topics, F.array().cast("array<string>")), lambda t: ~placeholder(t))
