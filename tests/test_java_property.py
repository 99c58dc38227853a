"""Property test for Java span extraction: random classes built from parts
whose spans are known by construction."""

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.operators.chunking import java_spans

NAMES = st.from_regex(r"[a-z][a-zA-Z0-9]{0,8}", fullmatch=True).filter(
    lambda n: n not in {"if", "for", "while", "switch", "catch", "do", "try", "new", "return", "else", "case",
                        "class", "enum", "record", "interface", "int", "void", "assert", "throw", "synchronized"})
BODY_LINES = st.lists(st.sampled_from([
    'String s = "}{";', "char c = '{';", "// } comment", "/* { */ int x = 1;", "if (a > 1) { a = a - 1; }",
    "return;", "Runnable r = new Runnable() { public void run() { } };"]), max_size=3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(NAMES, st.sampled_from(["void", "int", "String", "List<String>"]), BODY_LINES),
                max_size=5, unique_by=lambda m: m[0]),
       st.booleans())
def test_spans_by_construction(methods, nested):
    lines = ["package p;", "", "public class Outer {"]
    expected = []
    for name, rtype, body in methods:
        start = len(lines) + 1
        lines.append(f"    public {rtype} {name}(int a) {{")
        lines.extend("        " + b for b in body)
        lines.append("    }")
        expected.append(("method", name, start, len(lines), "Outer"))
    if nested:
        start = len(lines) + 1
        lines += ["    static class Inner {", "        void inner() { }", "    }"]
        expected += [("class", "Inner", start, start + 2, "Inner"), ("method", "inner", start + 1, start + 1, "Inner")]
    lines.append("}")
    expected.insert(0, ("class", "Outer", 3, len(lines), "Outer"))
    got = [(k, n, s, e, p) for k, n, s, e, _b, p, _t, _d in java_spans("\n".join(lines))]
    assert got == expected
