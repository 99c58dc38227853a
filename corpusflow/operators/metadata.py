"""File handlers and structure analysis.

Handlers are column expressions chosen by suffix; users register their own
with ``register_handler`` (the Spark form of the reference's handler class).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import line_count

# Handler names, suffixes, description texts and limits.
JAVA_HANDLER, MARKDOWN_HANDLER, YAML_HANDLER = "JavaFileHandler", "MarkdownFileHandler", "YamlFileHandler"
JAVA_DESC, JAVA_IN_PACKAGE, JAVA_CLASSES = "Java file", " in package ", " containing classes: "
MD_DESC, MD_SECTIONS, MD_MAX_SECTIONS = "Documentation file", " with sections: ", 3
YAML_DESC, YAML_PROPS, YAML_MAX_KEYS = "YAML configuration file", " with properties: ", 5
MAX_EXAMPLES = 3

# Java, from the language's grammar. Comments and string or character literals are blanked first. A look at the next
# character comes first: nearly every place of a text fails there.
JAVA_OPAQUE = (r"""(?s)(?=["'/])(?:"{3}.*?"{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|/\*.*?\*/|//[^\n]*)""")
JAVA_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
JAVA_QUALIFIED = JAVA_NAME + r"(?:\s*\.\s*" + JAVA_NAME + ")*"
JAVA_STATEMENT = r"(?m)(?=[\sip])(?:^|(?<=;))\s*+"  # package and import clauses stand at the start of a statement
JAVA_PACKAGE = JAVA_STATEMENT + r"package\s+(" + JAVA_QUALIFIED + r")\s*;"
JAVA_IMPORT = JAVA_STATEMENT + r"import\s+(?:static\s+)?(" + JAVA_QUALIFIED + r"(?:\s*\.\s*\*)?)\s*;"
JAVA_TYPE = (r"(?=[cier])(?<![\p{L}\p{N}_$.])(?:class|interface|enum|record)\s+(" + JAVA_NAME
             + r")(?=\s*[<({]|\s+(?:extends|implements|permits)\b)")
# Markdown: fenced code is blanked; a heading has one to six marks, a blank, and text.
MD_FENCE = r"(?sm)^ {0,3}`{3}[^\n]*\n.*?(?:^ {0,3}`{3}[^\n]*$|\z)"
MD_HEADING = r"(?dm)^ {0,3}#{1,6}[ \t]+([^ \t\n][^\n]*)$"
# YAML: a plain or quoted scalar at the start of a line, then a colon that ends the line or precedes a blank.
YAML_TOP_KEY = r"(?dm)^[\"']?([^\s#\"'\[\]{}&*!|>%@`,?:-][^\n:#\"']*?)[\"']?[ \t]*:(?=[ \t]|$)"


def _extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _described(intro: str, *parts: tuple[Column, str, Column]) -> Column:
    """``intro``, then label and value of each part whose condition holds."""
    return F.concat(F.lit(intro), *[F.when(there, F.concat(F.lit(label), value)).otherwise(F.lit("")) for there, label, value in parts])


def _java_code(content: Column) -> Column:
    return F.regexp_replace(content, JAVA_OPAQUE, " ")


def _tight(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _java_facts(code: Column) -> dict[str, Column]:
    return {"package": F.nullif(_tight(F.regexp_extract(code, JAVA_PACKAGE, 1)), F.lit("")), "classes": _extract_all(code, JAVA_TYPE)}


def _java_description(package: Column, classes: Column) -> Column:
    return _described(JAVA_DESC, (package.isNotNull(), JAVA_IN_PACKAGE, package),
                      (F.size(classes) > 0, JAVA_CLASSES, F.array_join(classes, ", ")))


def with_java_code(files: DataFrame) -> DataFrame:
    """Files with ``code``, their content without comments and literals: a projection of its own, so that ``java_metadata``
    has it once a file."""
    return files.withColumn("code", _java_code(F.col("content")))


def java_metadata(content: Column, code: Column | None = None) -> dict[str, Column]:
    """Package, declared types, imports, lines; and the X12 description. Words in comments and
    literals do not count. ``code``: the column of ``with_java_code``."""
    code = _java_code(content) if code is None else code
    facts = _java_facts(code)
    return {"file_type": F.lit("java"), **facts, "imports": F.transform(_extract_all(code, JAVA_IMPORT), _tight),
            "lines": line_count(content), "description": _java_description(**facts)}


def _markdown_open(content: Column) -> Column:
    return F.regexp_replace(content, MD_FENCE, "")


def _markdown_facts(text: Column) -> dict[str, Column]:
    return {"headings": F.transform(_extract_all(text, MD_HEADING), lambda h: F.rtrim(h))}


def _markdown_description(headings: Column) -> Column:
    return _described(MD_DESC, (F.size(headings) > 0, MD_SECTIONS, F.array_join(F.slice(headings, 1, MD_MAX_SECTIONS), ", ")))


def markdown_metadata(content: Column) -> dict[str, Column]:
    """Headings outside code blocks, lines, code fence flag; description with three sections."""
    facts = _markdown_facts(_markdown_open(content))
    return {"file_type": F.lit("markdown"), **facts, "lines": line_count(content),
            "has_code_blocks": content.contains("```"), "description": _markdown_description(**facts)}


def _yaml_facts(content: Column) -> dict[str, Column]:
    return {"top_level_keys": F.array_sort(F.array_distinct(_extract_all(content, YAML_TOP_KEY)))}


def _yaml_description(top_level_keys: Column) -> Column:
    return _described(YAML_DESC, (F.size(top_level_keys) > 0, YAML_PROPS, F.array_join(F.slice(top_level_keys, 1, YAML_MAX_KEYS), ", ")))


def yaml_metadata(content: Column) -> dict[str, Column]:
    """Top-level keys (distinct, sorted: decision 18), lines; description
    with the first five keys."""
    facts = _yaml_facts(content)
    return {"file_type": F.lit("yaml"), **facts, "lines": line_count(content), "description": _yaml_description(**facts)}


@dataclass
class Handler:
    """``columns(content)`` gives description, lines and more. A handler whose description needs costly facts may
    also give it in steps, each computed once a file: ``clean`` text, ``facts`` of it, ``described`` by them."""

    name: str
    suffixes: list[str]
    columns: callable  # content Column -> dict[str, Column] with at least description and lines
    extras: list[str] = field(default_factory=list)
    file_type: str | None = None
    clean: callable = None
    facts: callable = None
    described: callable = None


_HANDLERS: list[Handler] = [
    Handler(JAVA_HANDLER, [".java"], java_metadata, file_type="java", clean=_java_code, facts=_java_facts, described=_java_description),
    Handler(MARKDOWN_HANDLER, [".md"], markdown_metadata, file_type="markdown", clean=_markdown_open, facts=_markdown_facts,
            described=_markdown_description),
    Handler(YAML_HANDLER, [".yaml", ".yml"], yaml_metadata, file_type="yaml", facts=_yaml_facts, described=_yaml_description),
]


def register_handler(name: str, suffixes: list[str], columns) -> None:
    """Add a handler; ``columns(content) -> {name: Column}`` must give
    ``description`` and ``lines``. Earlier handlers win on a shared suffix."""
    _HANDLERS.append(Handler(name, suffixes, columns))


def handlers() -> list[Handler]:
    return list(_HANDLERS)


def handler_of(rel_path: Column) -> Column:
    """U8: name of the first handler whose suffix matches; null when none."""
    expr = F.lit(None).cast("string")
    for h in reversed(_HANDLERS):
        cond = None
        for s in h.suffixes:
            c = rel_path.endswith(s)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(h.name)).otherwise(expr)
    return expr


def file_metadata(files: DataFrame) -> DataFrame:
    """U8: handler, file type, description and line count per file (null
    handler for files without one). Each handler's expressions apply only to
    its own rows; cleaned texts and the facts of a description are projections of their
    own, so no pattern runs twice over a file."""
    content, stepwise = F.col("content"), [h for h in _HANDLERS if h.facts]
    mine = lambda h: F.col("handler") == h.name
    clean = F.lit(None).cast("string")
    for h in stepwise:
        clean = F.when(mine(h), h.clean(content) if h.clean else content).otherwise(clean)
    facts = {h.name: f"_facts{k}" for k, h in enumerate(stepwise)}
    out = files.withColumn("handler", handler_of(F.col("rel_path"))).withColumn("_clean", clean)
    out = out.withColumns({facts[h.name]: F.when(mine(h), F.struct(*[c.alias(n) for n, c in h.facts(F.col("_clean")).items()])) for h in stepwise})
    desc, lines, ftype = (F.lit(None).cast(t) for t in ("string", "int", "string"))
    for h in reversed(_HANDLERS):
        if h.facts:
            names = h.facts(F.col("_clean"))
            cols = {"description": h.described(**{n: F.col(facts[h.name])[n] for n in names}), "lines": line_count(content), "file_type": F.lit(h.file_type)}
        else:
            cols = h.columns(content)
        desc = F.when(mine(h), cols["description"]).otherwise(desc)
        lines = F.when(mine(h), cols["lines"]).otherwise(lines)
        ftype = F.when(mine(h), cols.get("file_type", F.lit(h.name))).otherwise(ftype)
    return out.select("rel_path", "handler", ftype.alias("file_type"), desc.alias("description"),
                      lines.alias("lines"))


def files_by_extension(files: DataFrame) -> DataFrame:
    """Count by extension over all files of the walk (unlisted ones too)."""
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))


def files_by_handler(files: DataFrame) -> DataFrame:
    """Per handler, file count, extension of its first file and up to
    three example paths (first in path order).

    Handlers are few, so the examples use a row_number <= 3 filter, which
    Spark runs as a per-partition top-3 before the shuffle; counts are
    partial aggregates.
    """
    tagged = files.withColumn("handler", handler_of(F.col("rel_path"))).where(F.col("handler").isNotNull())
    counts = tagged.groupBy("handler").agg(F.count(F.lit(1)).alias("n_files"),
                                           F.min_by("ext", "rel_path").alias("extension"))
    w = Window.partitionBy("handler").orderBy("rel_path")
    first3 = (tagged.select("handler", "rel_path", F.row_number().over(w).alias("rn"))
              .where(F.col("rn") <= MAX_EXAMPLES)
              .groupBy("handler").agg(F.sort_array(F.collect_list(F.struct("rn", "rel_path"))).alias("_e")))
    ex = first3.select("handler", F.transform("_e", lambda e: e["rel_path"]).alias("examples"))
    return counts.join(ex, "handler")


def analyze_structure(files: DataFrame) -> DataFrame:
    """A7 and A8 in one long table (kind = 'extension' or 'handler')."""
    by_ext = files_by_extension(files).select(
        F.lit("extension").alias("kind"), F.col("ext").alias("key"), "n_files",
        F.lit(None).cast("string").alias("extension"), F.lit(None).cast("array<string>").alias("examples"))
    by_handler = files_by_handler(files).select(
        F.lit("handler").alias("kind"), F.col("handler").alias("key"), "n_files", "extension", "examples")
    return by_ext.unionByName(by_handler)
