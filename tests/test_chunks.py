import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skeinlake.operators import chunks as C
from skeinlake.operators import graph as G
from skeinlake.operators import references as R
from skeinlake.operators import scanners as S

TS = '''import { add as plus } from "./math.js";
// class Fake {}
export class Shape {
  area(): number { return plus(1, 2); }
  static of(x) { return new Shape(); }
}
export default function () { return "}"; }
interface Props { a: string }
type Id = string;
const go = async (x: number) => {
  return x;
};
enum Color { Red }
'''


def ids(path, text, **k):
    return [c[0].removeprefix(path + "::") for c in C.file_chunks(path, text, **k)]


def test_script():
    assert ids("a/s.ts", TS) == [
        "module::default", "class::Shape", "class::Shape::method::area", "class::Shape::method::of", "function::default", "interface::Props", "type::Id", "function::go", "enum::Color",
    ]
    shape = C.file_chunks("a/s.ts", TS)[1]
    assert shape[3].startswith("export class Shape") and shape[3].endswith("}") and shape[4:6] == (2, 5)
    assert C.file_chunks("a/s.ts", TS)[0][5] == TS.count("\n")


@pytest.mark.parametrize("value", ['/[{"]/', "/[{]/", "/[`]/", '/["]/', "/a\\/{/g", "a / b", '`x ${a ? `{${b}` : "}"} {`', "x++ / 2 / y", "f(`${`}`}`)", "(1 + 2) / 3 / {}.y", "<b>{x}</b>", "[/}/, /{/]"])
def test_script_with_regular_expressions_and_templates(value):
    text = f"const re = {value};\nexport class A {{ m(s) {{ if (s) /}}/.test(s); return 1; }} }}\nexport function g() {{ return /[}}/]{{/; }}\n"
    assert ids("a.ts", text) == ["module::default", "class::A", "class::A::method::m", "function::g"]


@given(st.text(alphabet="ab/`'\"{}()$\\\n[]*= ", max_size=60))
def test_silent_script_keeps_places(text):
    for strings in (False, True):
        quiet = S.silent_script(text, strings)
        assert len(quiet) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(quiet) if c == "\n"]


def test_quoted_braces_of_other_languages():
    assert ids("g.go", "var q = `\\`\nfunc A() string {\n return `{` + string('{')\n}\nfunc B() {}\n") == ["module::default", "function::A", "function::B"]
    assert ids("c.cs", 'class A {\n  public string P() { return @"c:\\"; }\n  public int B() { return 1; }\n}\n') == ["module::default", "class::A", "method::P", "method::B"]


def test_other_languages():
    php = "<?php\nnamespace A;\nclass K { public function run($a) { return '}'; } }\ntrait T { function t() {} }\nfunction f() {}\n"
    assert ids("k.php", php) == ["module::default", "class::K", "class::K::method::run", "trait::T", "trait::T::method::t", "function::f"]
    assert ids("q.sql", "CREATE FUNCTION app.total(x int) RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql;\nSELECT 1;\nCREATE PROCEDURE p() BEGIN SELECT 2; END;") == ["module::default", "function::app.total", "function::p"]
    assert ids("r.rb", "class A\n  def b?\n    1\n  end\nend\nmodule M\nend\n") == ["module::default", "class::A", "method::b?", "module::M"]
    assert ids("c.cs", "class A {\n  public int B(int x) { return x; }\n}\nenum E { X }\n") == ["module::default", "class::A", "method::B", "enum::E"]
    assert ids("g.go", "func A() int {\n return 1\n}\nfunc (r R) B() {}\n") == ["module::default", "function::A"]
    assert ids("p.py", "def f():\n  pass\n") == ["module::default"]
    assert ids("y.yaml", "a: 1\nb:\n  c: 2\n#x\n") == ["module::default", "block::a", "block::b"]
    assert C.file_chunks("y.yaml", "a: 1\nb: 2")[1][3:6] == ("a: 1", 0, 0)


def test_styles():
    css = ".card { color: red; background: blue; border: 1px solid black; margin: 0; padding: 0; }\n@import url('x.css');\n.s { a: b }\n@media print { .card { color: red; background: blue; border: 1px solid black; margin: 0 0 0 0 0; } }\n"
    assert ids("a.css", css) == ["module::default", "rule::.card", "at_rule::@import url('x.css')", "at_rule::@media print", "rule::.card#L3"]
    scss = "@mixin m($x) { a: $x }\n.a {\n  &-b, .c { color: red; background: blue; border: 1px solid black; margin: 0; padding: 0; }\n  // .no { }\n}\n"
    assert ids("a.scss", scss) == ["module::default", "mixin::m", "rule::.a", "rule::.a-b, .a .c"]


def test_xml_by_path():
    di = '<config>\n <type name="A">\n  <plugin name="p"/>\n </type>\n <!-- <type name="no"/> -->\n <preference for="I" type="C"/>\n</config>'
    assert ids("etc/di.xml", di) == ["module::default", "element::type[A]", "element::plugin[p]", "element::preference[I]"]
    assert ids("etc/other.xml", di) == ["module::default"]
    assert ids("etc/di.xml", "<a><b></a>") == ["module::default"]
    assert "element::block[x]" in ids("m/view/frontend/layout/d.xml", '<page><block name="x"></block></page>')


@given(st.text(alphabet="ab\n\r\u2028", max_size=80), st.integers(1, 20))
def test_parts_join_to_the_text(text, most):
    parts = C.split_text(text, most)
    assert "".join(parts) == text and all(len(p) <= most for p in parts)


def test_oversize(spark):
    rows = [("m", "f", "module", "\n".join(["x" * 900] * 3), 0, 2, "text"), ("t", "f", "type", "y" * 5000, 0, 0, "text")]
    df = spark.createDataFrame(rows, "id string, file_path string, chunk_type string, content string, start_line int, end_line int, language string")
    got = {(r.id, r.start_line, r.end_line) for r in C.split_oversize(df, {"module": 1000}).collect()}
    assert got == {("m#part1", 0, 0), ("m#part2", 1, 1), ("m#part3", 2, 2), ("t", 0, 0)}
    assert C.split_oversize(df, {"module": 10}, "truncate").where("id = 'm'").first().content == "x" * 10 + "\n...[TRUNCATED]"


def test_markdown_and_windows(spark):
    df = spark.createDataFrame([("a.md", "intro\n# One Two!\ntext\n## B\n"), ("b.md", "plain\ntext"), ("c.md", "")], "file_path string, content string")
    got = {(r.id, r.start_line, r.end_line, r.content) for r in C.markdown_sections(df).collect()}
    assert got == {("a.md::doc::one-two#L1", 1, 2, "# One Two!\ntext"), ("a.md::doc::b#L3", 3, 4, "## B\n"), ("b.md::doc::default", 0, 1, "plain\ntext"), ("c.md::doc::default", 0, 0, "")}
    lines = spark.createDataFrame([("f", "\n".join(map(str, range(n)))) for n in (1, 50, 51, 130)], "file_path string, content string")
    spans = sorted((r.start_line, r.end_line) for r in C.line_windows(lines).collect())
    assert spans == [(0, 0), (0, 49), (0, 49), (0, 49), (40, 50), (40, 89), (80, 129)]


def test_chunk_files_routes_by_extension(spark):
    df = spark.createDataFrame([("a.md", "# T\n"), ("s.ts", "function f() {}\n"), ("n.ts", None)], "file_path string, content string")
    assert {r.id for r in C.chunk_files(df).collect()} == {"a.md::doc::t#L0", "s.ts::module::default", "s.ts::function::f", "n.ts::module::default"}


def test_edges_from_source(spark):
    files = [("src/a.ts", 'import { f, g as h } from "./b.js";\nimport fs from "fs";\nexport { f } from "./b";\nexport * from "./c";\nfunction run() { h(); f(); other(); }\n'), ("src/b.ts", "export function f() {}\nexport function g() {}\n"), ("src/c/index.ts", "export class K {}\n")]
    df = spark.createDataFrame(files, "file_path string, content string")
    got = {tuple(r) for r in R.extract_edges(df, C.chunk_files(df)).collect()}
    a, b = "src/a.ts::module::default", "src/b.ts"
    assert got == {
        (a, f"{b}::module::default", "IMPORTS"), (a, f"{b}::function::f", "RE_EXPORTS"), (a, "src/c/index.ts::module::default", "RE_EXPORTS"),
        ("src/a.ts::function::run", f"{b}::function::g", "CALLS"), ("src/a.ts::function::run", f"{b}::function::f", "CALLS"),
    }


def test_edges_past_strings_and_with_several_candidates(spark):
    text = 'const g = "src/*";\nimport { f } from "./b";\nconst t = `\nimport { x } from "./no"\n${f(1)}`;\nexport function run() { f(); new f(); } /* end */\n'
    files = [("src/a.ts", text), ("src/b.ts", "export function f() {}\n"), ("src/b/index.ts", "export function f() {}\n"), ("src/no.ts", "export const x = 1;\n"), ("n.ts", None)]
    df = spark.createDataFrame(files, "file_path string, content string")
    got = sorted(tuple(r) for r in R.extract_edges(df, C.chunk_files(df)).collect())
    a = "src/a.ts::module::default"
    assert got == sorted([(a, "src/b.ts::module::default", "IMPORTS"), (a, "src/b.ts::function::f", "CALLS"), ("src/a.ts::function::run", "src/b.ts::function::f", "CALLS")])


def test_surfaces(spark):
    files = [("a.ts", "export function f(a: string): void { return; }\nfunction hidden() {}\nexport type T = number;\n"), ("b.py", "class A:\n    def m(self, x):\n        pass\n"), ("c.txt", "x")]
    got = {r.path: (r.surface, r.strategy) for r in R.api_surface(spark.createDataFrame(files, "file_path string, content string")).collect()}
    assert got["a.ts"] == ("export function f(a: string): void { ... }\n\nexport type T = number;", "declarations")
    assert got["b.py"] == ("class A { ... }\n\ndef m(self, x) { ... }", "signatures")
    assert got["c.txt"] == ("", "unsupported")


def test_edges_send_no_table_to_the_driver(spark):
    """Paths compress to nothing, so that sizes of files would have let Spark broadcast whole tables."""
    files = [(f"s{i}/a.ts", 'import { f } from "./b";\nexport { f } from "./b";\nf();\n') for i in range(50)] + [(f"s{i}/b.ts", "export function f() {}\n") for i in range(50)]
    df = spark.createDataFrame(files, "file_path string, content string")
    found = R.extract_edges(df, C.chunk_files(df))
    assert found.count() == 150
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    ids = df.select(df.file_path.alias("id"))
    edges = df.select(df.file_path.alias("source_id"), df.file_path.alias("target_id"))
    assert "BroadcastHashJoin" not in G.valid_edges(edges, ids)._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_cut_into_small_pieces():
    batch = pa.RecordBatch.from_pydict({"file_path": list("abcd"), "content": ["x" * 5, "y" * 30, "", "z" * 4]})
    got = [p.column(0).to_pylist() for p in C._pieces(batch, 10)]
    assert got == [["a"], ["b"], ["c", "d"]]
    assert list(C._pieces(batch.slice(0, 0))) == []


def test_truncation_needs_no_python(spark):
    rows = [("a", "f", "module", "é\n" * 8 + "x", 3, 11, "text"), ("b", "f", "module", "short", 0, 0, "text"), ("c", "f", "doc", "y" * 20, 0, 0, "text"), ("d", "f", "module", None, 0, 0, "text")]
    df = spark.createDataFrame(rows, "id string, file_path string, chunk_type string, content string, start_line int, end_line int, language string")
    out = C.split_oversize(df, {"module": 5}, "truncate")
    assert "MapIn" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.content, r.end_line) for r in out.collect()} == {"a": ("é\né\né\n...[TRUNCATED]", 6), "b": ("short", 0), "c": ("y" * 20, 0), "d": (None, 0)}
