"""Java span extraction (U1): decisions 1-5 of the survey, on small sources."""

from corpusflow.operators import chunking
from corpusflow.operators.chunking import java_spans


def spans(src):
    return [(k, n, s, e, p) for k, n, s, e, _body, p, _t, _d in java_spans(src)]


def test_fixture_shape():
    src = ("package com.shop.p1;\n\nimport java.util.List;\nimport com.shop.base.*;\n\n"
           "public class Order5Controller { /** Handles order 5. */\n"
           "    public static void get1(int a) {\n        if (a > 1) { a = a - 1; }\n"
           "        System.out.println(a);\n    }\n}")
    out = java_spans(src)
    assert [(k, n, s, e) for k, n, s, e, *_ in out] == [
        ("class", "Order5Controller", 6, 11), ("method", "get1", 7, 10)]
    cls = out[0]
    assert cls[7] == "/** Handles order 5. */"          # first javadoc inside
    assert out[1][4].startswith("public static void get1") and out[1][4].endswith("}")
    assert out[1][6] == "void"


def test_single_space_method_and_keywords_not_methods():
    src = ("class A {\n  public void f() {\n    if (x) { y(); } else if (z) { w(); }\n"
           "    Runnable r = new Runnable() { public void run() { } };\n  }\n}")
    names = [(k, n) for k, n, *_ in spans(src)]
    assert names == [("class", "A"), ("method", "f")]   # anonymous run() is not a member of A


def test_generics_enum_record():
    src = ("public class Box<T extends Comparable<T>> extends Base<T> implements I<T> {\n"
           "  public <R> List<R> map(Function<T, R> fn) throws IOException {\n    return null;\n  }\n}\n"
           "enum Color { RED, GREEN }\n"
           "record Point(int x, int y) {\n  int sum() { return x + y; }\n}\n")
    got = [(k, n, p) for k, n, _s, _e, p in spans(src)]
    assert ("class", "Box", "Box") in got
    assert ("method", "map", "Box") in got
    assert ("class", "Color", "Color") in got
    assert ("class", "Point", "Point") in got
    assert ("method", "sum", "Point") in got


def test_braces_in_strings_and_comments():
    src = ('class S {\n  String a = "}{";\n  char c = \'{\';\n  // }\n  /* { */\n'
           '  void g() { String s = "}"; }\n}\nclass T { }\n')
    got = spans(src)
    assert ("class", "S", 1, 7, "S") in got
    assert ("method", "g", 6, 6, "S") in got
    assert ("class", "T", 8, 8, "T") in got


def test_unbalanced_runs_to_end():
    src = "class U {\n  void h() {\n    int x = 1;\n"
    got = spans(src)
    assert got[0] == ("class", "U", 1, 4, "U")
    assert got[1] == ("method", "h", 2, 4, "U")


def test_nested_class_methods_once_under_innermost():
    src = ("class Outer {\n  void a() { }\n  static class Inner {\n    void b() { }\n  }\n}\n")
    got = spans(src)
    methods = [(n, p) for k, n, _s, _e, p in got if k == "method"]
    assert methods == [("a", "Outer"), ("b", "Inner")]


def test_javadoc_directly_before_wins():
    src = ("class D {\n  /** Adds one. */\n  @Override\n  public int inc(int a) {\n"
           "    /** inner */\n    return a + 1;\n  }\n}\n")
    m = [x for x in java_spans(src) if x[0] == "method"][0]
    assert m[7] == "/** Adds one. */"
    assert m[2] == 4   # starts at the first token of the declaration


def test_constructors_are_methods_of_their_class():
    src = ("public class Box {\n  private int v;\n  public Box(int v) {\n    this.v = v;\n  }\n"
           "  Box() { this(0); }\n  int get() { return v; }\n}\n")
    got = [(k, n, s, e, p) for k, n, s, e, _b, p, _t, _d in java_spans(src)]
    assert got == [("class", "Box", 1, 8, "Box"), ("method", "Box", 3, 5, "Box"),
                   ("method", "Box", 6, 6, "Box"), ("method", "get", 7, 7, "Box")]


def test_heads_met_often_are_not_tried_again(monkeypatch):
    asked = []

    class Counted:
        def fullmatch(self, text, *rest, pattern=chunking._METHOD_HEAD):
            asked.append(text)
            return pattern.fullmatch(text, *rest)
    monkeypatch.setattr(chunking, "_METHOD_HEAD", Counted())
    member = "  public static int get{0}(int a) {{ if (a > 1) {{ a = 1; }} return a; }}\n"
    found = chunking.java_block_spans(["class A {\n" + "".join(member.format(k) for k in range(50)) + "}"] * 2)
    assert [[m[1] for m in file] for file in found] == [["A", *(f"get{k}" for k in range(50))]] * 2
    assert {m[7] for m in found[1][1:]} == {"int"} and len(asked) <= 10


def test_member_heads_of_all_forms():
    heads = ["void a()", "int[] b()", "int c() [ ]", "List<T>  d()\n", "void e() throws X,\n Y", "@On(x) final\tint f()", "<T> T g()", "void h()\x0b \n \n \n \n ",
             "void é()", "a.b.C $i()", "A()", "<T>A()", "public A()", "B()", "new j()", "import k()", "void if()", "9x()", "void 9y()", "void l(int a))"]
    src = "class A {" + "".join(h + "{ }" for h in heads) + "}"
    assert [(n, t) for _k, n, *_r, t, _d in java_spans(src)][1:] == [
        ("a", "void"), ("b", "int[]"), ("c", "int"), ("d", "List<T>"), ("e", "void"), ("f", "int"), ("g", "T"), ("h", "void"),
        ("$i", "a.b.C"), ("A", "A"), ("A", "A"), ("A", "public")]
    assert java_spans(src * 2)[-1][:2] == ("method", "A")
