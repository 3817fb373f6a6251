import pytest
from pyspark.sql import functions as F

from tracewake.functions import text as T
from tracewake.operators import diffs, search, symbols

DIFF = "\n".join(
    [
        "diff --git a/x.go b/x.go", "new file mode 100644", "--- /dev/null", "+++ b/x.go", "@@ -0,0 +1,3 @@", "+package x", "+func Pay(a int) {", "+}",
        "diff --git a/y.py b/y.py", "--- a/y.py", "+++ b/y.py\r", "@@ -10,2 +20 @@ def old():", " ctx", "-gone", "+def añadir():", "+def added(x):\r", "@@ -90,3 +0,0 @@", "+def late():", "\\ No newline at end of file", "+def later(a):",
        "+++ /dev/null", "@@ -1 +1 @@", "+func Hidden() {", "+++ plus plus", "+func InPlus() {", "",
    ]
)


def test_changed_functions(spark):
    df = spark.createDataFrame([("a", DIFF), ("n", None), ("e", "")], "id string, input_diff string")
    got = [(r.file, r.line, r.func_name) for r in diffs.changed_functions(df).orderBy("file", "line").collect()]
    assert got == [("plus plus", 1, "InPlus"), ("x.go", 2, "Pay"), ("y.py", 22, "added"), ("y.py", 23, "late"), ("y.py", 25, "later")]


@pytest.mark.parametrize(
    ("line", "name"),
    [("+func (s *S) Do(x int) {", "Do"), ("+async function f(", "f"), ("+export const g = async (", "g"), ("+\treturn foo(x)", "foo"), ("+\telse if (", "if"), ("+\tgo func() {", "func"), ("+new Foo(", "Foo"), ("+public static void main(", None), ("+export function b(", None), ("+async def g(", None), ("+func Gen[T any](", None)],
)
def test_function_patterns(spark, line, name):
    assert spark.range(1).select(diffs.function_name(F.lit(line))).first()[0] == name


def test_hunk_start(spark):
    lines = ["@@ -1,2 +20,3 @@", "@@ -1 +21 @@", "@@ -1 @@", "@@ -0,0 +0,0 @@", "@@ -1 +99999999999 @@"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(diffs.hunk_start(F.col("t"))).collect()] == [20, 21, 0, 0, 0]


def test_repo_inference(spark):
    repos = spark.createDataFrame([(1, "core"), (2, "pay")], "ord int, repo_name string")
    fn = spark.createDataFrame([("pay/x",), ("pay.y",), ("payment",), ("core/z",), (None,)], "func_name string")
    assert {r.func_name: r.repo for r in diffs.infer_repo(fn, repos).collect()} == {"pay/x": "pay", "pay.y": "pay", "payment": "core", "core/z": "core", None: "core"}
    assert {r.repo for r in diffs.infer_repo(fn, repos.limit(0)).collect()} == {"unknown"}


@pytest.mark.parametrize(
    ("pattern", "path", "ok"),
    [("**", "a/b/c", True), ("**/x.go", "x.go", True), ("**/x.go", "a/b/x.go", True), ("a/**/x.go", "a/x.go", True), ("a/**/x.go", "b/x.go", False), ("a/**", "a/b/c", True), ("*.go", "a/x.go", False), ("[a-c]*.g?", "bb.go", True), ("[a-c]*.g?", "dd.go", False), ("a+b.go", "a+b.go", True), ("a+b.go", "aab.go", False)],
)
def test_glob(spark, pattern, path, ok):
    assert spark.range(1).select(F.lit(path).rlike(T.glob_to_regex(pattern))).first()[0] is ok


def test_lines_slices_and_layers(spark):
    df = spark.createDataFrame([("a", "one\r\ntwo\nthree\n", 2), ("e", "", 1), ("n", None, 1)], "path string, content string, at int")
    lines = search.lines_of(df, "path", "content")
    assert [(r.path, r.line_no, r.text) for r in lines.orderBy("line_no").collect()] == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three")]
    assert [r.text for r in search.line_range(lines, 2, 1).collect()] == ["two"]
    got = {r.path: r.slice for r in search.slices(df, "path", "content", 2, 5).collect()}
    assert got == {"a": "     2\ttwo\n     3\tthree\n", "e": "(file has fewer than 2 lines)", "n": None}
    assert {r.path: r.slice for r in search.slices(df, "path", "content", 0, 0).collect()}["a"].startswith("     1\tone\n")
    assert {r.path: r.slice for r in search.layered(df, "path", "content", "at", 0).collect()}["a"] == "a:2"
    assert {r.path: r.slice for r in search.layered(df, "path", "content", "at", 2).collect()}["a"].count("\n") == 3
    with pytest.raises(ValueError, match="above"):
        search.layered(df, "path", "content", "at", 3, 2)


def test_matches_and_cap(spark):
    lines = spark.createDataFrame([("b/x.go", 1, "foo bar"), ("a/y.py", 2, "foo"), ("a/y.py", 1, "foo")], "path string, line_no int, text string")
    assert search.matching_lines(lines, "^foo$", glob="**/*.py").count() == 2
    assert search.matching_lines(lines, fixed="o b").count() == 1
    assert [(r.path, r.line_no) for r in search.capped(lines, 2).collect()] == [("a/y.py", 1), ("a/y.py", 2)]


def test_verified_nodes(spark):
    nodes = [("r", "a.go", "Pay"), ("r", "a.go", "Nope"), ("r", None, "Pay"), ("r", "", "Gone"), ("q", "a.go", "Pay"), ("q", None, "Pay"), (None, None, "nc P"), ("q", None, "c"), ("q", None, ""), ("q", None, None), ("q", None, "y()\nx"), ("q", None, "(*Store).Run"), ("q", None, "Runs")]
    df = spark.createDataFrame(nodes, "repo string, file_path string, func_name string")
    files = spark.createDataFrame([("r", "a.go", "func Pay()\nx"), ("r", "b.go", None), ("s", "c.go", "go (*Store).Run now")], "repo string, path string, content string")
    want = {("r", "a.go", "Pay"), ("r", None, "Pay"), ("q", None, "Pay"), (None, None, "nc P"), ("q", None, "c"), ("q", None, "(*Store).Run")}
    for name_bytes in (search.NAME_BYTES, 0):
        got = {(r.repo, r.file_path, r.func_name): r.verified for r in search.verified(df, files, name_bytes).collect()}
        assert got == {n: n in want for n in nodes}
    assert search.verified(df, files.limit(0)).where("verified").count() == 0


def test_declarations_in_a_long_hunk_take_linear_time(spark):
    import time

    def seconds(n):
        text = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -0,0 +1,9 @@\n" + "".join(f"+func F{k}() {{\n-old\n+}}\n" for k in range(n))
        t = time.time()
        rows = diffs.changed_functions(spark.createDataFrame([("a", text)], "id string, input_diff string")).agg({"line": "max", "func_name": "count"}).first()
        assert rows[0] == 2 * n - 1 and rows[1] == n or rows[1] == 2 * n - 1 and rows[0] == n
        return time.time() - t

    seconds(100)
    assert seconds(8000) < 4


def test_symbols_by_language(spark):
    code = {
        "go": "package x\n     2\ttype T struct {\ntype I interface {\ntype N int\nfunc (t T) Do() {",
        "python": "def f(x):\n  class A:",
        "java": "public class J {\n  public static void main(String[] a) {\n",
        "js": "export class C {\nconst f = async (x) =>\nlet g = function (",
    }
    df = spark.createDataFrame([(k, v, None) for k, v in code.items()] + [("given", "class Z {", "tsx"), ("unknown", "class Z {\nfunc g() {", "rust"), ("n", None, None), ("e", "", None)], "id string, code string, lang string")
    got = {}
    for r in symbols.symbols(df, "id", "code", "lang").orderBy("id", "line").collect():
        got.setdefault(r.id, []).append((r.name, r.kind, r.line))
    assert got["go"] == [("T", "class", 2), ("I", "interface", 3), ("N", "type", 4), ("Do", "function", 5)]
    assert got["python"] == [("f", "function", 1), ("A", "class", 2)]
    assert got["java"] == [("J", "class", 1), ("main", "function", 2)]
    assert got["js"] == [("C", "class", 1), ("f", "function", 2), ("g", "function", 3)]
    assert got["given"] == [("Z", "class", 1)]
    assert got["unknown"] == [("Z", "class", 1), ("g", "function", 2)]
    assert set(got) == {"go", "python", "java", "js", "given", "unknown"}


def test_list_items_and_paths(spark):
    row = spark.range(1).select(T.list_items(F.lit(" - * a \n\n--b\n* c\r\n")), T.relative_path(F.lit("/w/a/b"), "/w/"), T.uri_to_path(T.path_to_uri(F.lit("/w/a"))), T.match_line(F.lit("p"), F.lit(3), F.lit("x:y"))).first()
    assert list(row) == [["a", "-b", "c"], "a/b", "/w/a", "p:3:x:y"]
