"""Cut source files into file-, class- and method-level chunks.

Input is a ``files`` table (rel_path, ext, content, ...). File chunks and
generic chunks are pure column expressions. Java class and method spans need paired
brackets, which are found for blocks of files at once in ``mapInArrow``; it returns members' texts,
names and raw comments, and native columns derive ids, hashes and descriptions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import describe, ids, paths

CHUNK_COLUMNS = ["chunk_id", "file_path", "file_type", "chunk_type", "chunk_name", "start_line",
                 "end_line", "code_content", "description", "context", "checksum", "extracted_at",
                 "parent_class", "parent_method"]

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("chunk_name", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("code_content", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("extracted_at", T.TimestampType()),
    T.StructField("parent_class", T.StringType()),
    T.StructField("parent_method", T.StringType()),
])


def line_count(content: Column) -> Column:
    """``len(text.split('\\n'))``."""
    return (F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("int")


def _stamp(extracted_at: Column | None) -> Column:
    return extracted_at if extracted_at is not None else F.current_timestamp()


# ---------------------------------------------------------------------------
# Generic files
# ---------------------------------------------------------------------------

def extract_generic_chunks(files: DataFrame, extracted_at: Column | None = None,
                           id_width: int = ids.GENERIC_ID_WIDTH, carry: list[str] | None = None) -> DataFrame:
    """Whole file as one chunk; ``carry`` columns are passed through."""
    name = paths.basename(F.col("rel_path"))
    return files.select(
        ids.generic_chunk_id(F.col("rel_path"), id_width).alias("chunk_id"),
        F.col("rel_path").alias("file_path"),
        F.regexp_replace(F.col("ext"), r"^\.", "").alias("file_type"),
        F.lit("file").alias("chunk_type"),
        name.alias("chunk_name"),
        F.lit(1).alias("start_line"),
        line_count(F.col("content")).alias("end_line"),
        F.col("content").alias("code_content"),
        F.concat(F.lit("File: "), name).alias("description"),
        F.lit("").alias("context"),
        ids.checksum(F.col("content")).alias("checksum"),
        _stamp(extracted_at).alias("extracted_at"),
        F.lit(None).cast("string").alias("parent_class"),
        F.lit(None).cast("string").alias("parent_method"),
        *(carry or []),
    )


# ---------------------------------------------------------------------------
# Java files
# ---------------------------------------------------------------------------

# Comments, text blocks, string and char literals; masked before matching so
# braces and keywords inside them do not count.
_LITERALS = re.compile(
    r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:.|\n)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?',
    re.DOTALL)
_CLASS_KEYWORD = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)")
_CLASS_HEAD = re.compile(
    r"\s*(?:@[\w$.]+(?:\s*\([^()]*\))?\s*)*"
    r"((?:(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp)\s+)*)")
# A method body opens after ")" (array dims, throws clause); the head before
# the matching "(" is then matched in full from the previous ; { or }.
_METHOD_TAIL = re.compile(r"\)\s*(?:\[\s*\]\s*)*(?:throws\s+[\w$.,\s<>]+?)?\s*\{")
_METHOD_HEAD = re.compile(
    r"\s*(?:@[\w$.]+(?:\s*\([^()]*\))?\s*)*"
    r"((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
    r"(?:<[^<>{};]*(?:<[^<>{};]*>[^<>{};]*)*>\s*)?"
    r"([A-Za-z_$][\w$.]*(?:\s*<[^{};()]*>)?(?:\s*\[\s*\])*)\s+([A-Za-z_$][\w$]*))\s*")
_NOT_NAMES = frozenset("if for while switch catch synchronized return new else do try throw case assert".split())
_NOT_TYPES = frozenset("new return else throw case package import class interface enum record".split())
# A constructor head: modifiers and the class name, no return type.
_CTOR_HEAD = re.compile(
    r"\s*(?:@[\w$.]+(?:\s*\([^()]*\))?\s*)*"
    r"((?:(?:public|protected|private)\s+)?(?:<[^<>{};]*>\s*)?([A-Za-z_$][\w$]*))\s*")
_BETWEEN_DOC_AND_DECL = re.compile(r"\s*(?:@[\w$.]+(?:\s*\([^()]*\))?\s*)*")


#: Parts the files of a block: no pattern matches it and no statement crosses it.
_PART = "\0"
_KEYWORDS = ("class", "interface", "enum", "record")
_NOT_NEWLINE = re.compile(r"[^\n]")


def _blank(m: re.Match) -> str:
    text = m.group()
    return _NOT_NEWLINE.sub(" ", text) if "\n" in text else " " * len(text)


def _masked(texts: list[str]) -> tuple[str, np.ndarray, list[int], list[int]]:
    """(the texts joined by _PART, each character of a comment or literal but its line ends blanked;
    first characters of the texts and, last, the end; starts and ends of javadoc comments)."""
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    docs_from, docs_to, parts = [], [], []
    for text, first in zip(texts, firsts.tolist()):
        if "/" in text or '"' in text or "'" in text:
            code, done = [], 0
            for m in _LITERALS.finditer(text):
                a, b = m.span()
                if text.startswith("/**", a) and not text.startswith("/**/", a):
                    docs_from.append(first + a)
                    docs_to.append(first + b)
                code += text[done:a], _blank(m)
                done = b
            text = "".join([*code, text[done:]]) if code else text
        parts.append(text.replace(_PART, " ") if _PART in text else text)
    return _PART.join(parts) + _PART, firsts, docs_from, docs_to


def _paired(opens: np.ndarray, part: np.ndarray, nested: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Brackets in order, each of one part: (its other half, the bracket that opens around it if ``nested``), -1 for none.
    Depths are running sums, floored at the part's start so that a closing bracket too many is left out; in an
    order by depth, stable in the place, the halves of a pair stand side by side."""
    n = len(opens)
    half, around = np.full(n, -1), np.full(n, -1)
    if not n:
        return half, around
    step = np.where(opens, 1, -1)
    first = np.maximum.accumulate(np.where(np.append(True, part[1:] != part[:-1]), np.arange(n), 0))
    run = np.cumsum(step)
    ground = -part.astype(np.int64) * 2 * n      # lower for every further part, so that the floor starts anew
    level = run - (run[first] - step[first]) + ground
    floor = np.minimum.accumulate(np.minimum(level, ground))
    before = np.minimum(np.concatenate([[0], floor[:-1]]), ground)
    depth = level - floor + ~opens
    real = np.flatnonzero(opens | (floor == before))
    key = depth[real]
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")   # short keys sort in linear time
    key, by_depth = key[order], real[order]
    a, b = by_depth[:-1], by_depth[1:]
    pair = opens[a] & ~opens[b] & (key[:-1] == key[1:]) & (part[a] == part[b])
    half[a[pair]], half[b[pair]] = b[pair], a[pair]
    if not nested:
        return half, around
    # the last bracket one level up that stands before
    place = key * n + by_depth
    inner = np.flatnonzero(opens & (depth > 1))
    up = np.searchsorted(place, (depth[inner] - 1) * n + inner) - 1
    around[inner] = by_depth[up]
    return half, around


def _class_heads(masked: str) -> list[re.Match]:
    """Matches of _CLASS_KEYWORD in order, none inside another, found by the words themselves."""
    hits = []
    for word in _KEYWORDS:
        at = masked.find(word)
        while at >= 0:
            hits.append(at)
            at = masked.find(word, at + len(word))
    hits.sort()
    found, last = [], 0
    for at in hits:
        m = _CLASS_KEYWORD.match(masked, at) if at >= last else None
        if m is not None:
            found.append(m)
            last = m.end()
    return [m for m in found if not (m.start() and masked[m.start() - 1] in "$.@")]  # Foo.class, @interface


# White space as in patterns, of one byte a character (others than Latin-1 are "?").
_IS_SPACE = np.array([chr(c).isspace() for c in range(256)])
# What ends lines, statements, bodies, parameters and files.
_IS_MARK = np.isin(np.arange(256), [ord(c) for c in "\n{}();" + _PART]).tobytes()
#: What stands before a name is tried so often in a block; from then on the answer is known.
_TRIED = 3


def _class_prefix(text: str) -> int:
    """Where the declaration of a class starts in the text before its keyword."""
    h = _CLASS_HEAD.fullmatch(text)
    return h.start(1) if h is not None and h.group(1) else len(text)


def _member_head(text: str) -> tuple[int, str | None, str] | None:
    """(start, return type or None for a constructor, name) of the head before a member's parentheses."""
    if (words := text.split()) and words[-1] in _NOT_NAMES:
        return None    # if (a) { ... }: neither pattern's name
    h = _METHOD_HEAD.fullmatch(text)
    if h is None:
        c = _CTOR_HEAD.fullmatch(text)
        return (c.start(1), None, c.group(2)) if c is not None and c.group(2) not in _NOT_NAMES else None
    rtype, name = h.group(2, 3)
    if name in _NOT_NAMES or rtype in _NOT_TYPES:
        return None
    return h.start(1), rtype if rtype.isidentifier() else re.sub(r"\s+", " ", rtype), name


def _member_prefix(text: str) -> tuple[int, str | None] | None:
    """Start and return type of any member whose name is the next word: the patterns end with the name, so which
    it is does not matter."""
    head = _member_head(text + " x")
    return None if head is None else head[:2]


def _method_tails(masked: str, chars: np.ndarray, at: np.ndarray, since: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """The ")" before each of the open braces ``at`` that open a method's body, -1 for the others. ``since``: starts of
    the braces' statements; ``closing``: all ")"."""
    before = at - 1
    for _ in range(4):
        before = before - _IS_SPACE[chars[before]]
    close = np.where(chars[before] == ord(")"), before, -1)
    # more space, array dimensions or a throws clause: the last ")" of the statement, if the pattern leads from there
    place = np.searchsorted(closing, at) - 1
    left = closing[place] if len(closing) else close
    for k in np.flatnonzero((close < 0) & (place >= 0) & (left >= since)).tolist():
        m = _METHOD_TAIL.match(masked, int(left[k]))
        if m is not None and m.end() == at[k] + 1:
            close[k] = left[k]
    return close


_SPAN_FIELDS = ("part", "kind", "name", "line", "last_line", "start", "end", "parent", "return_type", "javadoc")


def _block_columns(texts: list[str]) -> dict[str, np.ndarray]:
    """The spans of ``java_block_spans`` by columns, of all files in order; ``part`` is the file's number. Brackets
    are paired for the whole block at once; patterns look only at declaration heads."""
    masked, firsts, docs_from, docs_to = _masked(texts)
    coded = masked.encode("latin-1", "replace")   # one byte a character
    chars = np.frombuffer(coded, np.uint8)
    marks = np.flatnonzero(np.frombuffer(coded.translate(_IS_MARK), bool))
    mark = chars[marks]
    newlines, ends = marks[mark == 10], mark == ord(_PART)
    part_of_mark = np.cumsum(ends) - ends

    def brackets(pair: str, nested: bool):
        opening = mark == ord(pair[0])
        both = np.flatnonzero(opening | (mark == ord(pair[1])))
        return marks[both], *_paired(opening[both], part_of_mark[both], nested)
    braces, brace_half, brace_around = brackets("{}", True)
    parens, paren_half, _ = brackets("()", False)
    ends |= (mark == ord(";")) | (mark == ord("{"))
    heads, stops = marks[ends], marks[ends | (mark == ord("}"))]

    def segments(at: np.ndarray) -> np.ndarray:
        """Starts of the statements or bodies that places lie in."""
        k = np.searchsorted(stops, at)
        return np.where(k > 0, stops[np.maximum(k - 1, 0)] + 1, 0)

    # classes: their starts, names and open braces
    starts, names, opens = [], [], []
    class_prefixes: dict[str, int] = {}
    found = _class_heads(masked)
    if found:
        keyword = np.array([m.start() for m in found])
        opened = heads[np.searchsorted(heads, np.array([m.end() for m in found]))]
        for m, kw, k, seg in zip(found, keyword.tolist(), opened.tolist(), segments(keyword).tolist(), strict=True):
            if masked[k] == "{":
                if (prefix := masked[seg:kw]) not in class_prefixes:
                    class_prefixes[prefix] = _class_prefix(prefix)
                starts.append(seg + class_prefixes[prefix])
                names.append(m.group(2))
                opens.append(k)
    if not starts:
        return {f: np.zeros(0, np.int64 if f in ("part", "line", "last_line", "start", "end") else object) for f in _SPAN_FIELDS}
    n = len(starts)
    owner = np.full(len(braces), -1)     # the class whose body a brace opens
    owner[np.searchsorted(braces, opens)] = np.arange(n)
    # members: a member lies directly inside a class body (no call like foo(x) { ... }), a constructor in its own class
    body = np.flatnonzero((brace_around >= 0) & (owner[brace_around] >= 0))
    close = _method_tails(masked, chars, braces[body], segments(braces[body]), parens[chars[parens] == ord(")")])
    body, close = body[close >= 0], close[close >= 0]
    half = paren_half[np.searchsorted(parens, close)]
    opened = parens[half] if len(half) else close
    # no statement or body may end between the parentheses
    good = (half >= 0) & (np.searchsorted(stops, opened) == np.searchsorted(stops, close))
    body, opened = body[good], opened[good]
    rtypes: list[str | None] = []
    of_class, name_of_class = owner[brace_around[body]], names[:]
    took: list[int] = []
    took_add, start_add, name_add, rtype_add = took.append, starts.append, names.append, rtypes.append
    prefixes: dict[str, tuple[int, tuple[int, str | None] | None]] = {}
    for j, (k, i, c) in enumerate(zip(segments(opened).tolist(), opened.tolist(), of_class.tolist(), strict=True)):
        words = masked[k:i].rsplit(None, 1)
        if len(words) == 2 and (name := words[1]).isidentifier() and name.isascii():
            if name in _NOT_NAMES:
                continue
            times, head = prefixes.get(words[0], (0, None))
            if times < _TRIED:
                head = _member_prefix(words[0])
                prefixes[words[0]] = times + 1, head
            if head is None:
                continue
            first, rtype = head
        elif (found_head := _member_head(masked[k:i])) is not None:
            first, rtype, name = found_head
        else:
            continue
        if rtype is None:
            if name != name_of_class[c]:
                continue
            rtype = name                                             # returns its class
        took_add(j)
        start_add(k + first)
        name_add(name)
        rtype_add(rtype)
    # a class goes before a member that starts with it
    order = np.argsort(np.array(starts), kind="stable")
    start, at = np.array(starts)[order], np.concatenate([np.searchsorted(braces, opens), body[np.array(took, int)]])[order]
    part = np.searchsorted(firsts, start, side="right") - 1
    last = firsts[part + 1] - 1                       # the end of the file's text
    end = np.where(brace_half[at] >= 0, braces[brace_half[at]] + 1, last)
    lines = np.searchsorted(newlines, np.stack([start, end])) - np.searchsorted(newlines, firsts[part]) + 1
    javadocs = np.full(len(order), None)
    if docs_from:
        before = np.searchsorted(docs_to, start, side="right") - 1
        inside = np.searchsorted(docs_from, start)
        from_, to = np.array(docs_from), np.array(docs_to)
        some = (before >= 0) & (from_[np.maximum(before, 0)] >= firsts[part])
        some |= (inside < len(from_)) & (to[np.minimum(inside, len(from_) - 1)] <= end)
        for k in np.flatnonzero(some).tolist():
            a, b, doc, inner, text, first = int(start[k]), int(end[k]), int(before[k]), int(inside[k]), texts[part[k]], int(firsts[part[k]])
            # javadoc directly before the declaration, else the first one inside
            if doc >= 0 and docs_from[doc] >= first:
                s, e = docs_from[doc], docs_to[doc]
                if _BETWEEN_DOC_AND_DECL.fullmatch(masked, e, a) and not text[text.rfind("\n", 0, s - first) + 1:s - first].strip():
                    javadocs[k] = text[s - first:e - first]
            if javadocs[k] is None and inner < len(docs_from) and docs_to[inner] <= b:
                javadocs[k] = text[docs_from[inner] - first:docs_to[inner] - first]
    is_class = order < n
    return dict(zip(_SPAN_FIELDS, (
        part, _objects(["method", "class"])[is_class.astype(int)], _objects(names)[order], lines[0], lines[1], start - firsts[part], end - firsts[part],
        _objects(name_of_class)[np.concatenate([np.arange(n), of_class[np.array(took, int)]])[order]], _objects([None] * n + rtypes)[order], javadocs),
        strict=True))


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


#: A lone file of so many characters at most is walked, since arrays cost some hundred calls however short they are.
WALK_CHARS = 1 << 13
_STOPS_AND_PARENS = re.compile(r"[{}();\0]")


def _walked_spans(text: str) -> list[tuple]:
    """The spans of ``java_block_spans`` of one short file, by one walk over its brackets."""
    masked, _, docs_from, docs_to = _masked([text])
    found = _class_heads(masked)
    if not found:
        return []
    stops, heads, closing = [], [], []          # as in _block_columns
    brace_half, around, paren_half = {}, {}, {}
    braces, parens = [], []                     # those that are open
    for m in _STOPS_AND_PARENS.finditer(masked):
        at, c = m.start(), m.group()
        if c == "(":
            parens.append(at)
        elif c == ")":
            closing.append(at)
            if parens:
                paren_half[at] = parens.pop()
        else:
            stops.append(at)
            if c == "}":
                if braces:
                    brace_half[braces.pop()] = at
            else:
                heads.append(at)
                if c == "{":
                    around[at] = braces[-1] if braces else -1
                    braces.append(at)

    def segment(at: int) -> int:
        k = bisect_left(stops, at)
        return stops[k - 1] + 1 if k else 0
    rows, owner = [], {}                        # rows: (start, open brace, type, name, parent, return type)
    for m in found:
        k = heads[bisect_left(heads, m.end())]
        if masked[k] == "{":
            seg = segment(m.start())
            owner[k] = m.group(2)
            rows.append((seg + _class_prefix(masked[seg:m.start()]), k, "class", m.group(2), m.group(2), None))
    for at, outer in around.items():
        if (parent := owner.get(outer)) is None:
            continue
        close = at - 1
        for _ in range(4):
            close -= masked[close].isspace() and masked[close] < "\u0100"
        if masked[close] != ")":
            place = bisect_left(closing, at) - 1
            close = closing[place] if place >= 0 and closing[place] >= segment(at) else -1
            m = _METHOD_TAIL.match(masked, close) if close >= 0 else None
            if m is None or m.end() != at + 1:
                continue
        opened = paren_half.get(close)
        if opened is None or bisect_left(stops, opened) != bisect_left(stops, close):
            continue
        seg = segment(opened)
        if (head := _member_head(masked[seg:opened])) is not None:
            first, rtype, name = head
            if rtype is not None or name == parent:
                rows.append((seg + first, at, "method", name, parent, rtype or name))
    rows.sort(key=lambda r: r[0])
    out = []
    for start, at, kind, name, parent, rtype in rows:
        end = brace_half[at] + 1 if at in brace_half else len(text)
        doc, k, inner = None, bisect_right(docs_to, start) - 1, bisect_left(docs_from, start)
        if k >= 0:
            a, b = docs_from[k], docs_to[k]
            if _BETWEEN_DOC_AND_DECL.fullmatch(masked, b, start) and not text[text.rfind("\n", 0, a) + 1:a].strip():
                doc = text[a:b]
        if doc is None and inner < len(docs_from) and docs_to[inner] <= end:
            doc = text[docs_from[inner]:docs_to[inner]]
        out.append((kind, name, masked.count("\n", 0, start) + 1, masked.count("\n", 0, end) + 1, start, end, parent, rtype, doc))
    return out


def java_block_spans(texts: list[str]) -> list[list[tuple]]:
    """Class and method spans of a block of Java files, a list per file of
    (chunk_type, name, start_line, end_line, start, end, parent, return_type, raw_javadoc), start and end
    in characters."""
    if len(texts) == 1 and len(texts[0]) <= WALK_CHARS:
        return [_walked_spans(texts[0])]
    out: list[list[tuple]] = [[] for _ in texts]
    for part, *row in zip(*(v.tolist() for v in _block_columns(texts).values()), strict=True):
        out[part].append(tuple(row))
    return out


def java_spans(text: str) -> list[tuple]:
    """Class and method spans of one Java file.

    Returns tuples (chunk_type, name, start_line, end_line, content, parent,
    return_type, raw_javadoc). Classes include generic, enum and record forms;
    a method belongs to its innermost enclosing class only; braces inside
    strings and comments are ignored; an unbalanced body runs to the end.
    """
    return [(k, n, sl, el, text[so:eo], p, t, d) for k, n, sl, el, so, eo, p, t, d in java_span_offsets(text)]


def java_span_offsets(text: str) -> list[tuple]:
    """As ``java_spans`` with (start, end) character offsets instead of text."""
    return java_block_spans([text])[0]


_MEMBER_FIELDS = [("chunk_type", "string"), ("chunk_name", "string"), ("start_line", "int32"),
                  ("end_line", "int32"), ("code", "string"), ("parent_class", "string"),
                  ("return_type", "string"), ("javadoc", "string"), ("nth", "int32")]
MEMBERS_DDL = ("rel_path string, chunk_type string, chunk_name string, start_line int, end_line int, code string, "
               "parent_class string, return_type string, javadoc string, nth int")


def _nth(part: np.ndarray, kind: np.ndarray, line: np.ndarray) -> np.ndarray:
    """How many members before one have the same file, type and first line."""
    code = np.sort((part << 32 | line) * 2 + (kind == "class"))
    if not (code[1:] == code[:-1]).any():
        return np.zeros(len(code), np.int32)
    rows = list(zip(part.tolist(), list(kind), line.tolist(), strict=True))
    seen: dict[tuple, int] = {}
    out = []
    for row in rows:
        out.append(seen.get(row, 0))
        seen[row] = out[-1] + 1
    return np.array(out, np.int32)


#: Characters of files that are worked on at once (one file at least).
BLOCK_CHARS = 1 << 20


def file_blocks(sizes: list[int]):
    """(first, end) of runs of files of some BLOCK_CHARS characters together."""
    a, n = 0, 0
    for k, size in enumerate(sizes):
        if n and n + size > BLOCK_CHARS:
            yield a, k
            a, n = k, 0
        n += size
    if a < len(sizes):
        yield a, len(sizes)


def _java_members_arrow(with_file: bool):
    """Arrow batches of (rel_path, content, others) in, rows of members out, a bounded number of characters at a time.
    Members go by columns: (path, type, name, first line, last line, text, parent, return type, javadoc, nth, others), ``nth``
    the number of members of one type before it that start on the same line."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        kinds = [pa.int32() if t == "int32" else pa.string() for _, t in _MEMBER_FIELDS]
        for rb in batches:
            sizes = pc.fill_null(pc.binary_length(rb.column(1)), 0).to_pylist()
            others = list(range(2, rb.num_columns))
            names = ["rel_path", *(n for n, _ in _MEMBER_FIELDS), *(rb.schema.names[k] for k in others)]
            for a, b in file_blocks(sizes):
                part = rb.slice(a, b - a)
                texts = part.column(1).to_pylist()
                some = np.flatnonzero(part.column(1).is_valid().to_numpy(zero_copy_only=False))   # null is no file
                texts = texts if len(some) == len(texts) else [t or "" for t in texts]
                c = _block_columns(texts)
                owner, columns = c["part"], [c[f] for f in ("kind", "name", "line", "last_line", "start", "end", "parent", "return_type", "javadoc")]
                columns.append(_nth(owner, c["kind"], c["line"]))
                if with_file:   # one more member of each file, before the others
                    one, none = np.ones(len(some), np.int32), np.full(len(some), None)
                    found = [texts[k] for k in some.tolist()]
                    whole = [np.full(len(some), "file", object), np.full(len(some), "file_content", object), one,
                             np.array([t.count("\n") + 1 for t in found], np.int32), one - 1, np.array([len(t) for t in found], np.int64),
                             none, none, none, one - 1]
                    owner = np.concatenate([some, owner])
                    order = np.argsort(owner, kind="stable")
                    owner, columns = owner[order], [np.concatenate(pair)[order] for pair in zip(whole, columns, strict=True)]
                start, end = columns[4:6]
                columns[4:6] = [[texts[p][x:y] for p, x, y in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True)),
                                                  *(part.column(k).take(rows) for k in others)], names=names)
    return run


def java_member_chunks(files: DataFrame, extracted_at: Column | None = None,
                       width: int = ids.CHUNK_HASH_WIDTH, with_file: bool = False) -> DataFrame:
    """Class and method chunks (and the file chunk when ``with_file``): the Arrow function returns
    each member with its text, so that a file is cut in one pass however many members it has;
    ids, hashes and descriptions are derived natively. Members of one type on one line get
    ids ``..._{line}``, ``..._{line}.2``, and so on."""
    hashed = files.select("rel_path", "content", ids.path_hash(F.col("rel_path"), width).alias("path_hash"))   # once a file
    flat = (hashed.mapInArrow(_java_members_arrow(with_file), MEMBERS_DDL + ", path_hash string")
            .withColumnRenamed("code", "code_content"))
    doc = F.nullif(describe.clean_javadoc(F.col("javadoc")), F.lit(""))
    kind = F.col("chunk_type")
    inferred = (F.when(kind == "method", describe.describe_method(F.col("chunk_name"), F.col("return_type")))
                .when(kind == "class", describe.describe_class(F.col("chunk_name")))
                .otherwise(describe.describe_file(F.col("code_content"))))
    line = F.when(kind == "file", F.lit("0")).otherwise(F.col("start_line").cast("string"))
    place = F.when(F.col("nth") > 0, F.concat_ws(".", line, (F.col("nth") + 1).cast("string"))).otherwise(line)
    return flat.select(
        ids.member_id(F.col("path_hash"), kind, place).alias("chunk_id"),
        F.col("rel_path").alias("file_path"),
        F.lit("java").alias("file_type"),
        "chunk_type", "chunk_name", "start_line", "end_line", "code_content",
        F.coalesce(doc, inferred).alias("description"),
        F.when(kind == "method", F.col("parent_class")).otherwise(F.lit("")).alias("context"),
        ids.checksum(F.col("code_content")).alias("checksum"),
        _stamp(extracted_at).alias("extracted_at"),
        "parent_class",
        F.lit(None).cast("string").alias("parent_method"),
    )


def extract_java_chunks(files: DataFrame, extracted_at: Column | None = None,
                        width: int = ids.CHUNK_HASH_WIDTH) -> DataFrame:
    """File chunk + class chunks + method chunks of Java files, from one
    pass over each file."""
    return java_member_chunks(files, extracted_at, width, with_file=True)


# ---------------------------------------------------------------------------
# Dispatch by extension (U3) and the extractor registry
# ---------------------------------------------------------------------------

Extractor = Callable[[DataFrame, "Column | None"], DataFrame]
_EXTRACTORS: dict[str, Extractor] = {".java": extract_java_chunks}


def register_extractor(ext: str, fn: Extractor) -> None:
    """Route files with ``ext`` to ``fn(files, extracted_at) -> chunks``."""
    _EXTRACTORS[ext] = fn


def registered_extractors() -> dict[str, Extractor]:
    return dict(_EXTRACTORS)


def extract_chunks(files: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """Each registered extension to its extractor, the rest to U2."""
    special = list(_EXTRACTORS)
    out = extract_generic_chunks(files.where(~F.col("ext").isin(special)), extracted_at)
    for ext, fn in _EXTRACTORS.items():
        out = out.unionByName(fn(files.where(F.col("ext") == ext), extracted_at).select(*CHUNK_COLUMNS))
    return out


def chunks_of_type(chunks: DataFrame, types: list[str]) -> DataFrame:
    """F4."""
    return chunks.where(F.col("chunk_type").isin(types))


def chunks_by_type(chunks: DataFrame) -> DataFrame:
    """A2."""
    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"))


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    """A4: chunk count stored per file."""
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("chunks_count"))


# ---------------------------------------------------------------------------
# SQL table function
# ---------------------------------------------------------------------------

def register_chunk_udtf(spark, name: str = "chunk_code"):
    """Register ``chunk_code`` for SQL: the class and method spans of Java files. With a table of the
    columns path and content, ``SELECT * FROM chunk_code(TABLE(files) PARTITION BY path)`` (any
    partitioning does, none too), it works on blocks of rows, as the chunker does, and returns the path
    too; other columns are ignored. ``LATERAL chunk_code(path, content)`` is the same for one row. Null content
    has no spans."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    fields = [("chunk_type", StringType()), ("chunk_name", StringType()), ("start_line", IntegerType()),
              ("end_line", IntegerType()), ("parent_class", StringType()), ("code_content", StringType())]
    spans = StructType([StructField(n, t) for n, t in fields])
    located = StructType([StructField("path", StringType()), *spans.fields])
    most = BLOCK_CHARS

    @udtf
    class ChunkCode:
        def __init__(self):
            self.held, self.size = [], 0

        @staticmethod
        def analyze(files: AnalyzeArgument, content: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not files.isTable:
                return AnalyzeResult(spans)
            if not {"path", "content"} <= {f.name for f in files.dataType.fields}:
                raise ValueError("chunk_code takes a table with the columns path and content")
            return AnalyzeResult(located)

        def eval(self, files, content=None):
            if not isinstance(files, str) and files is not None:
                if files["content"] is not None:
                    self.held.append((files["path"], files["content"]))
                    self.size += len(files["content"])
                if self.size > most:
                    yield from self.cut()
            else:
                for kind, cname, first, last, body, parent, _rtype, _doc in java_spans(content or ""):
                    yield kind, cname, first, last, parent, body

        def terminate(self):
            yield from self.cut()

        def cut(self):
            held, self.held, self.size = self.held, [], 0
            for (path, text), found in zip(held, java_block_spans([t for _, t in held]), strict=True):
                for kind, cname, first, last, a, b, parent, _rtype, _doc in found:
                    yield path, kind, cname, first, last, parent, text[a:b]

    spark.udtf.register(name, ChunkCode)
    return ChunkCode
