"""Rule-based descriptions and message columns.

All rules are CASE expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Texts that must equal the reference's output word for word.
# ---------------------------------------------------------------------------
FILE_DESCRIPTIONS = [  # (word contained in the file text, description); first match wins
    ("Controller", "REST API Controller handling HTTP requests"),
    ("Service", "Business logic service layer"),
    ("Repository", "Data access layer with database operations"),
    ("Config", "Configuration class"),
]
FILE_DESCRIPTION_DEFAULT = "Java source file"

CLASS_DESCRIPTIONS = [  # (words in the class name, template with {name}); first match wins
    (["Controller"], "REST API Controller: {name} handles HTTP requests and routing"),
    (["Service"], "Business Service: {name} implements core business logic"),
    (["Repository", "Dao"], "Data Access: {name} handles database operations"),
    (["Config"], "Configuration: {name} defines application settings"),
    (["Model", "Entity", "DTO"], "Data Model: {name} represents domain object"),
]
CLASS_DESCRIPTION_DEFAULT = "Class: {name}"

METHOD_DESCRIPTIONS = [  # (name prefixes, description); first match wins
    (["get"], "Getter method for retrieving data"),
    (["set"], "Setter method for updating data"),
    (["create", "add"], "Creates or adds new data"),
    (["update"], "Updates existing data"),
    (["delete", "remove"], "Deletes data"),
    (["find", "search"], "Queries and retrieves data"),
]
METHOD_DESCRIPTION_DEFAULT = "Method: {name}() returns {type}"

FALLBACK_METHOD = "Method '{name}' in class {parent}"
FALLBACK_CLASS = "Java class '{name}'"
FALLBACK_OTHER = "Code content from {path}"

USAGE_UTILITY = "This is a utility method. Call {name}() to execute its operations."
USAGE_RETURNS = "This method returns a value. Use the result from {name}() for further processing."
USAGE_DEFAULT = "Call this method as: {name}()"

ERROR_MODES = [  # (exception class names, failure mode)
    (["TimeoutError"], "timeout"),
    (["SVNConnectionError", "GitPushError"], "transient"),
    (["SVNFetchError", "GitAuthenticationError"], "permanent"),
]
ERROR_MODE_DEFAULT = "permanent"

EMPTY_COMMIT_MESSAGE = "Empty commit"
DEFAULT_AUTHOR = "SVN Migration Bot"
# ---------------------------------------------------------------------------


def _fill(template: str, **cols: Column) -> Column:
    """Render ``template`` with ``{key}`` placeholders bound to columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(cols[rest[start + 1:end]])
        rest = rest[end + 1:]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def clean_javadoc(raw: Column) -> Column:
    """The comment's text: without its opening and closing, and without the star that starts
    a line; stars inside the text stay. White space around the text goes."""
    body = F.regexp_replace(raw, r"\A\s*/\*+", "")
    body = F.regexp_replace(body, r"\*+/\s*\z", "")
    body = F.regexp_replace(body, r"(?m)^([ \t]*)\*+(?!\S*\*)", "$1")
    return F.regexp_replace(body, r"(?U)^\s+|\s+$", "")


def describe_file(content: Column) -> Column:
    """X5."""
    expr = F.lit(FILE_DESCRIPTION_DEFAULT)
    for word, text in reversed(FILE_DESCRIPTIONS):
        expr = F.when(content.contains(word), F.lit(text)).otherwise(expr)
    return expr


def describe_class(name: Column) -> Column:
    """X6."""
    expr = _fill(CLASS_DESCRIPTION_DEFAULT, name=name)
    for words, template in reversed(CLASS_DESCRIPTIONS):
        cond = None
        for w in words:
            c = name.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, _fill(template, name=name)).otherwise(expr)
    return expr


def describe_method(name: Column, return_type: Column) -> Column:
    """X7."""
    expr = _fill(METHOD_DESCRIPTION_DEFAULT, name=name, type=F.coalesce(return_type, F.lit("")))
    for prefixes, text in reversed(METHOD_DESCRIPTIONS):
        cond = None
        for p in prefixes:
            c = name.startswith(p)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(text)).otherwise(expr)
    return expr


def fallback_description(description: Column, chunk_type: Column, name: Column,
                         parent: Column, path: Column) -> Column:
    """The chunk's description, or a generated one when it is empty."""
    fallback = (
        F.when(chunk_type == "method",
               _fill(FALLBACK_METHOD, name=name, parent=F.coalesce(parent, F.lit("None"))))
        .when(chunk_type == "class", _fill(FALLBACK_CLASS, name=name))
        .otherwise(_fill(FALLBACK_OTHER, path=path))
    )
    return F.coalesce(F.nullif(description, F.lit("")), fallback)


def usage_text(content: Column, name: Column) -> Column:
    """X9."""
    return (
        F.when(content.contains("void") & content.contains("System.out"), _fill(USAGE_UTILITY, name=name))
        .when(content.contains("return"), _fill(USAGE_RETURNS, name=name))
        .otherwise(_fill(USAGE_DEFAULT, name=name))
    )


def classify_error(error_class: Column) -> Column:
    """Failure mode of an exception class name."""
    expr = F.lit(ERROR_MODE_DEFAULT)
    for names, mode in reversed(ERROR_MODES):
        expr = F.when(error_class.isin(names), F.lit(mode)).otherwise(expr)
    return expr


def commit_message(message: Column, revision: Column, files_changed: Column) -> Column:
    """Trimmed message (or a placeholder), then the revision footer."""
    body = F.coalesce(F.nullif(F.regexp_replace(message, r"(?U)^\s+|\s+$", ""), F.lit("")),
                      F.lit(EMPTY_COMMIT_MESSAGE))
    footer = F.concat(F.lit("\n\n[SVN r"), revision.cast("string"), F.lit("]"))
    changed = F.when(F.coalesce(files_changed, F.lit(0)) != 0,
                     F.concat(F.lit(" | "), files_changed.cast("string"), F.lit(" files changed"))
                     ).otherwise(F.lit(""))
    return F.concat(body, footer, changed)


def author_or_default(author: Column, default: str = DEFAULT_AUTHOR) -> Column:
    """X21."""
    return F.coalesce(F.nullif(author, F.lit("")), F.lit(default))
