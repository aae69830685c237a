import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlake.operators import chunks as C
from skeinlake.operators import scripts as S
from skeinlake.plans.script_cases import CASES


@pytest.mark.parametrize("case", range(len(CASES)))
def test_case(case):
    path, text, want = CASES[case]
    got = [f"{c[0].removeprefix(path + '::')} {c[2]} {c[4]} {c[5]}" for c in C.file_chunks(path, text) if not c[0].endswith("::module::default")]
    assert sorted(got) == sorted(want)


def test_contents_are_whole():
    text = "class B<T extends { x: number }> {\n  @a() get(k: T): T { return k; }\n}\nexport const f = (x) => x, g = 1;\nconst h = async () => {\n  return 1;\n};\n"
    got = {c[0]: c[3] for c in C.file_chunks("a.ts", text)}
    assert got["a.ts::class::B"] == text[: text.index("export")].rstrip()
    assert got["a.ts::class::B::method::get"] == "get(k: T): T { return k; }"
    assert got["a.ts::function::f"] == "export const f = (x) => x, g = 1;"
    assert got["a.ts::function::h"] == "async () => {\n  return 1;\n}"


#: What may be put in without a declaration going: types, decorators, elements, values.
_TYPES = ("", "<T>", "<T extends { x: number }>", "<T = {}>", "<K extends keyof T, V = Map<K, { a: () => void }>>")
_BASES = ("", " extends B", " extends B<{ a: 1 }>", " implements I<{ a: string }>, J<[1]>", " extends mix(A, { b: 1 })")
_RESULTS = ("", ": void", ": { a: string }", ": Promise<{ a: 1 }[]>", ": x is { a: 1 } | null", ": A extends B ? { c: 1 } : D")
_DECORATORS = ("", "@a ", "@a() ", "@a.b({ c: '}' }) ", "@a\n  @b(1)\n  ")
_BODIES = ("", "return 1;", "return <p a={() => 1}>it's {x} </p>;", "const r = /[{}'\"]/g;", "x = `${`}`} {`;", "if (a < b && c > d) { e(); }", "return { f() { return '}'; } };", "return a as { b: 1 };")
_BETWEEN = ("\n", " ", ";\n", "\n// don't\n", "\nconst z = 1\n", "\nlet q = <b>'</b>;\n", "\nfoo({ a: 1 })\n")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*(st.sampled_from(x) for x in (_TYPES, _BASES, _RESULTS, _DECORATORS, _BODIES, _BETWEEN))), min_size=1, max_size=5))
def test_no_declaration_goes(parts):
    text, want = "", set()
    for i, (types, bases, result, decorator, body, between) in enumerate(parts):
        text += f"{decorator}export class A{i}{types}{bases} {{ {decorator}m{i}{types}(x: {{ a: 1 }}){result} {{ {body} }}\n  n = 1; k{i}() {{}} }} function f{i}{types}(){result} {{ {body} }}{between}"
        want |= {f"class::A{i}", f"class::A{i}::method::m{i}", f"class::A{i}::method::k{i}", f"function::f{i}"}
    got = {p.name for p in S.script(text)}
    assert want <= got and {x for x in got if not x.endswith("::f")} == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>/{}()[]'\"`$=;:@\n class", max_size=80))
def test_any_text_ends(text):
    for jsx in (False, True):
        for p in S.script(text, jsx):
            assert 0 <= p.start < p.end <= len(text)


def test_long_text_in_reasonable_time():
    text = "export class A<T> { m(x: T) { return `${x}`; } }\n" * 4000
    assert len(S.script(text)) == 8000


def test_lines():
    assert [S.Lines("a\nb\n").of(i) for i in range(5)] == [0, 0, 1, 1, 2]
    assert re.fullmatch(r"\s*", S.silent_script("/* a */ `b` // c"))
