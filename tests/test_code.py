"""Chunker, splitter, scanner and paths on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.functions import names, paths, text, vectors
from corvella.operators.chunker import chunks
from corvella.operators.splitter import estimate, overlap_lines, split_by_tokens, split_chunk, split_long_line, split_words
from corvella.sources.codetree import scan, scan_counts
from corvella.sources.gitignore import Ignore


def kinds(source, language):
    return [(c.kind, c.start, c.end) for c in chunks(source, language)]


def count(source, language):
    out = {}
    for c in chunks(source, language):
        out[c.kind] = out.get(c.kind, 0) + 1
    return out


def test_javascript():
    assert kinds("function add(a, b) {\n  return a + b;\n}\n", "javascript") == [("function", 1, 3)]
    source = "class Calc {\n  add(a, b) {\n    return a + b;\n  }\n\n  sub(a, b) {\n    return a - b;\n  }\n}\n"
    assert kinds(source, "javascript") == [("class", 1, 9), ("method", 2, 4), ("method", 6, 8)]
    assert kinds("const multiply = (a, b) => {\n  return a * b;\n};\n", "javascript") == [("function", 1, 3)]
    one = chunks("// adds\nfunction add(a, b) {\n  return a + b;\n}\n", "javascript")
    assert [(c.kind, c.start) for c in one] == [("function", 1)] and one[0].content.startswith("// adds")
    two = "// one\n// two\nfunction first() {\n  return 1;\n}\n\nfunction second() {\n  return 2;\n}\n"
    assert kinds(two, "javascript") == [("function", 2, 5), ("function", 7, 9)]
    assert kinds("", "javascript") == kinds("// only\n/* comments */\n", "javascript") == []
    nested = "class A {\n  m() {\n    class B {\n      n() { return 1; }\n    }\n    return B;\n  }\n}\n"
    assert count(nested, "javascript") == {"class": 2, "method": 2}
    chunks("function broken( {\n  return\n", "javascript")
    assert kinds("if (a) { b(); }\nfor (;;) { c(); }\n", "javascript") == []
    assert count("const s = 'function x() {}'; /* class Y {} */", "javascript") == {}


def test_typescript():
    source = "interface User {\n  name: string;\n}\n\nexport function greet(u: User): string {\n  return u.name;\n}\n"
    assert kinds(source, "typescript") == [("interface", 1, 3), ("function", 5, 7)]
    source = "export class S {\n  constructor(private x: number) {}\n  get(): number {\n    return this.x;\n  }\n}\n"
    assert count(source, "typescript") == {"class": 1, "method": 2}


def test_python():
    source = 'class A:\n    """Doc."""\n\n    def one(self):\n        def inner():\n            pass\n\n    def two(self):\n        return 2\n\n\n# says\ndef free():\n    return 1\n'
    assert kinds(source, "python") == [("class", 1, 9), ("method", 2, 6), ("method", 5, 6), ("method", 8, 9), ("function", 12, 14)]
    assert chunks("def broken(:\n", "python") == []
    assert chunks("x = 1\n", "python") == []


def test_java():
    source = "package a;\nimport b.C;\n\npublic class Calc {\n  private int total = 0;\n  private final String name;\n\n  public Calc(String n) { this.name = n; }\n\n  public int add(int a, int b) {\n    if (a > 0) { return a; }\n    return a + b;\n  }\n\n  int sub(int a) { return -a; }\n}\n"
    assert count(source, "java") == {"class": 1, "field": 2, "method": 2}
    assert count("public interface Shape {\n  double area();\n}\n", "java") == {"interface": 1, "method": 1}


def test_csharp():
    source = "namespace N {\n  public class P {\n    public string Name { get; set; }\n    public int Age { get; private set; } = 3;\n\n    public P() { }\n\n    public int Twice(int x) { return 2 * x; }\n    private void Go() { }\n  }\n\n  public interface I { void Run(); }\n}\n"
    assert count(source, "csharp") == {"class": 1, "property": 2, "method": 3, "interface": 1}


def test_split():
    assert split_by_tokens("short", 100, 10) == ["short"]
    many = "\n".join(["This is a sentence."] * 100)
    parts = split_by_tokens(many, 50, 0)
    assert len(parts) > 1 and "\n".join(parts) == many
    assert all(estimate(p) <= 50 for p in split_long_line("This is a sentence. " * 100, 50))
    assert all(estimate(p) <= 50 for p in split_words("word " * 200, 50))
    assert split_long_line("... Only this.", 100) == ["Only this."]
    assert overlap_lines(["a" * 400, "b" * 400], 5) == ["b" * 400]
    assert overlap_lines(["a"], 0) == []
    long = list(split_chunk("\n".join(f"line {i} of the body" for i in range(300)), 10, "function", 100, 20))
    assert [k for *_, k in long][:2] == ["function_part_1", "function_part_2"] and long[0][1] == 10
    assert estimate("") == 0 and estimate("a😀") == 1 and estimate("abcde") == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab cd.!", max_size=30), max_size=30), st.integers(4, 40))
def test_split_keeps_every_word(lines, most):
    whole = "\n".join(lines)
    got = " ".join(split_by_tokens(whole, most, 0))
    assert [c for c in got if c in "abcd"] == [c for c in whole if c in "abcd"]


def test_paths_and_names(spark):
    cases = {"": None, ".ts": None, ".config.ts": "typescript", "C:\\a\\Main.java": "java", "/a/main.py": "python", "App.TS": "typescript", "Makefile": None, "a.b/.gitignore": None}
    df = spark.createDataFrame(list(cases), "string").toDF("p")
    assert {r["p"]: r["x"] for r in df.select("p", paths.language(F.col("p")).alias("x")).collect()} == cases
    df = spark.createDataFrame([("  My  Cool Project! ",), ("--a__b--",)], "n string")
    assert [r[0] for r in df.select(names.normalised(F.col("n"))).collect()] == [names.normalise("  My  Cool Project! "), "-a__b-".strip("-")]
    with pytest.raises(ValueError):
        names.normalise("!!!")
    row = spark.range(1).select(
        text.days_since(F.lit("")).alias("a"),
        text.days_since(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T01:00:00Z").cast("timestamp")).alias("b"),
        text.days_since(F.lit("nonsense")).alias("c"),
        vectors.confidence(F.lit(float("nan"))).alias("d"),
        text.file_hash(F.lit("Hello, World!")).alias("e"),
        text.memory_size(F.lit(1572864)).alias("f"),
        text.url_encode(F.lit("a b/ü")).alias("g"),
        text.percentage(F.lit(1), F.lit(3)).alias("h"),
        names.display_name(F.lit("my-cool_pROJECT")).alias("i"),
    ).first()
    assert tuple(row) == ("Unknown", "1 day ago", "Unknown", "low", "65a8e27d8879283831b664bd8b7f0ad4", "1.50 MB", "a%20b%2F%C3%BC", 33, "My Cool PROJECT")


def make(root, *files, **texts):
    for f in files:
        p = root / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    for f, t in texts.items():
        (root / f).write_text(t)


def test_scan(spark, tmp_path):
    make(tmp_path, "code.ts", "README.md", "config.json", "script.py", "Makefile", "__tests__/z.ts", "pkg/__init__.py", ".git/config", ".vscode/settings.json", "node_modules/a.js", "src/a.log", "a b-c_d.e.ts")
    (tmp_path / ".gitignore").write_text("node_modules/\n*.log\n")
    (tmp_path / "big.ts").write_text("x" * 2000)
    rows = {r["relativePath"]: r for r in scan(spark, str(tmp_path), max_file_size=1000).collect()}
    assert sorted(rows) == sorted(["code.ts", "README.md", "config.json", "script.py", "Makefile", "__tests__/z.ts", "pkg/__init__.py", "a b-c_d.e.ts"])
    assert rows["__tests__/z.ts"]["isTestFile"] and rows["Makefile"]["extension"] == "" and not rows["README.md"]["supported"]
    counts = scan_counts(str(tmp_path))
    assert counts["skippedHidden"] == 2 and counts["skippedByGitignore"] == 2
    assert scan(spark, str(tmp_path), respect_gitignore=False).count() == 11
    assert scan(spark, str(tmp_path / "missing")).count() == 0


def test_ignore():
    rules = Ignore("# note\n/top.ts\n*.tmp\n!keep.tmp\nbuild/\ndoc/**/x.md\n[ab].js\n")
    for path, want in {"top.ts": True, "d/top.ts": False, "d/a.tmp": True, "keep.tmp": False, "d/build/z.ts": True, "build": False, "doc/q/r/x.md": True, "doc/x.md": True, "a.js": True, "c.js": False}.items():
        assert rules.ignored(path) == want, path


def test_python_that_cannot_be_parsed():
    text = '''import os

# Says it.
def old(x):
    print "def no(): in a string", x
    y = """
def not_code():
"""
    return y

class Thing(object):
    """Text."""
    def run(self, a=[1,
2], b=(3)):
        def inner():
            exec "1"

        return inner

    async def later(self):
        pass

def broken(:
    pass

print "end"
'''
    got = [(c.kind, c.start, c.end, c.content.split("\n")[0]) for c in chunks(text, "python")]
    assert got == [
        ("function", 3, 9, "# Says it."),
        ("class", 11, 21, "class Thing(object):"),
        ("method", 13, 18, "def run(self, a=[1,"),
        ("method", 15, 16, "def inner():"),
        ("method", 20, 21, "async def later(self):"),
        ("function", 23, 24, "def broken(:"),
    ]
    assert chunks("x = (\n", "python") == [] and chunks("\0", "python") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="defclas x():\n\t \"'#\\[]=", max_size=200))
def test_any_text_can_be_read_by_indentation(source):
    from corvella.operators.chunker import _indented

    rows = source.count("\n") + 1
    for c in _indented(source):
        assert 1 <= c.start <= c.end <= rows and c.content.count("\n") == c.end - c.start


def test_large_files_take_linear_time():
    """Commented functions, classes and arrows of a megabyte; braces languages."""
    import time

    one = "// says what\nfunction name{i}(a, b) {{ return [a].map((x) => x + {i}); }}\n\n/* a class */\nclass Thing{i} {{ method{i}(a) {{ return a; }} }}\n"
    text = "".join(one.format(i=i) for i in range(1_000_000 // len(one)))
    began = time.monotonic()
    found = chunks(text, "javascript")
    assert time.monotonic() - began < 5
    assert len(found) == 4 * (1_000_000 // len(one)) and found[0].content.startswith("// says what") and found[0].start == 1
    java = "".join(f"/* doc */\npublic class A{i} {{ int x = {i}; /** m */ int m(int a) {{ return a; }} }}\n" for i in range(12_000))
    began = time.monotonic()
    assert len(chunks(java, "java")) == 36_000
    assert time.monotonic() - began < 5


def names_of(source, language):
    """(kind, first line of the chunk)."""
    return [(c.kind, c.content.split("\n")[0].strip()) for c in chunks(source, language)]


SCRIPTS = {
    "class A {\n  ['a' + b](x) { return 1; }\n  async *[Symbol.iterator]() { yield 1; }\n  static get 'q'() { return 2; }\n  #p() {}\n  x = () => 1;\n}\n": ["class A", "['a'", "async *[", "static get", "#p()", "() => 1"],
    "const s = `a ${list.map((x) => `${x} }`)} function f() {}`;\n": ["(x) =>"],
    "const f = <T,>(a: T): T => a;\n": ["<T,>(a"],
    "let g: (a: number) => void = (b) => {};\ntype H = (a: string) => void;\ninterface I { m: () => void; }\n": ["(b) =>", "interface I"],
    "const o = { run(a) { return a; }, go: (b) => b, 'x y'() {}, async z() {} };\n": ["run(a)", "(b) =>", "'x y'()", "async z"],
    "const r = /[/\\]}]function x(){/g.test(a / b) ? 1 : 2;\nfunction after() {}\n": ["function after"],
    "function* gen() {}\nabstract class B { abstract m(): void; n() {} }\nconst C = class { k() {} };\n": ["n()", "k()"],
    "export default function d() {}\nexport class E extends f(x) implements G<H> { o(): { a: 1 } { return q; } }\n": ["function d", "class E", "o():"],
    "foo(function () {}, async (a) => { await a; });\nif (a) { b(); } else { c(); }\nswitch (x) { case 1: { y(); } }\n": ["async (a)"],
    "const a = x\n  .map(y => y + 1)\n  .filter(z => {\n    return z;\n  });\n": ["y => y + 1", "z => {"],
    "function broken( {\n  return (;\n}\nfunction fine() { return 1; }\n": None,
}


@pytest.mark.parametrize("source", list(SCRIPTS))
def test_script_declarations(source):
    got = names_of(source, "typescript")
    if SCRIPTS[source] is None:
        assert isinstance(got, list)
    else:
        assert [g[1].startswith(w) for g, w in zip(got, SCRIPTS[source], strict=True)] == [True] * len(got), got


JAVA = """package p;
@Deprecated
public enum Op implements Runnable {
  ADD("+") {
    @Override public int of(int a, int b) { return a + b; }
  },
  SUB { int of(int a) { class Local { void go() {} } return 1; } };
  private final String sign = "{";
  abstract int of(int a, int b);
  Op(String s) { sign = s; }
}
class K<T extends Comparable<T>> {
  private Runnable r = new Runnable() {
    int n = 1;
    public void run() { call(() -> { new Thread() { public void start() {} }; }); }
  };
  static { init(); }
  @Named("a{") Map<String, List<T>> m, q;
  <U> U cast(Object o) { return (U) o; }
  K() { super(); }
  @interface Mark { int value() default 1; }
  record Point(int x, int y) { int sum() { return x + y; } }
}
interface Shape { double area(); default int n() { return 1; } }
"""
CSHARP = """using System;
namespace N.M {
  [Serializable]
  public class P<T> : Q where T : class {
    private int x = 3;
    public string Name { get; set; } = "a";
    public int Age => x + 1;
    public P(int a) : base(a) { }
    [Obsolete("}")] public async Task<int> Run(int y) { return await Go(() => { return y; }); }
    void One() => Two();
    public static P operator +(P a, P b) => a;
    public interface IIn { int Of(); }
    public struct S { public int V { get; } }
    Func<int> f = () => 1;
    public delegate void D(int a);
    public int this[int i] { get { return i; } }
    public event Action Done { add { } remove { } }
    enum E { A, B }
  }
  record R(int A) { public int Twice() { return 2 * A; } }
}
"""


def test_java_and_csharp_declarations():
    got = names_of(JAVA, "java")
    assert got == [
        ("method", "@Override public int of(int a, int b) { return a + b; }"),
        ("method", "int of(int a) { class Local { void go() {} } return 1; }"),
        ("class", "class Local { void go() {} }"),
        ("method", "void go() {}"),
        ("field", 'private final String sign = "{";'),
        ("method", "abstract int of(int a, int b);"),
        ("class", "class K<T extends Comparable<T>> {"),
        ("field", "private Runnable r = new Runnable() {"),
        ("field", "int n = 1;"),
        ("method", "public void run() { call(() -> { new Thread() { public void start() {} }; }); }"),
        ("method", "public void start() {}"),
        ("field", '@Named("a{") Map<String, List<T>> m, q;'),
        ("method", "<U> U cast(Object o) { return (U) o; }"),
        ("method", "int sum() { return x + y; }"),
        ("interface", "interface Shape { double area(); default int n() { return 1; } }"),
        ("method", "double area();"),
        ("method", "default int n() { return 1; }"),
    ]
    got = names_of(CSHARP, "csharp")
    assert got == [
        ("class", "[Serializable]"),
        ("property", 'public string Name { get; set; } = "a";'),
        ("property", "public int Age => x + 1;"),
        ("method", '[Obsolete("}")] public async Task<int> Run(int y) { return await Go(() => { return y; }); }'),
        ("method", "void One() => Two();"),
        ("interface", "public interface IIn { int Of(); }"),
        ("method", "int Of();"),
        ("property", "public int V { get; }"),
        ("method", "public int Twice() { return 2 * A; }"),
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["class ", "A ", "function ", "f", "(", ")", "{", "}", "[", "]", "`", "${", "=>", "=", ":", ";", ",", "<", ">", "/", '"', "'", "\n", "new ", "enum ", "@", "interface ", "//", "/*", "*/", "int "]), max_size=60).map("".join), st.sampled_from(["javascript", "typescript", "java", "csharp"]))
def test_any_text_has_chunks_inside_it(source, language):
    for c in chunks(source, language):
        assert c.content in source and 1 <= c.start <= c.end <= source.count("\n") + 1 and c.content.count("\n") == c.end - c.start


def test_deep_brackets():
    assert chunks("(" * 50_000 + "function f() {}" + ")" * 50_000, "javascript") is not None
    assert chunks("class A {" * 3000, "java") is not None
