"""Sources for the query and the tests of scanning, each with the chunks that stand in it: file name,
text, and `name kind first-line last-line` of every chunk but the module."""

from __future__ import annotations

CASES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("a.ts", "class B<T extends { x: number }> {\n  get(k: T): T { return k; }\n}\n", ("class::B class 0 2", "class::B::method::get method 1 1")),
    ("a.ts", "class B<T> extends C<{a: 1}> {\n  m() {}\n}\n", ("class::B class 0 2", "class::B::method::m method 1 1")),
    ("a.ts", "class C implements I<{a: string}>, J {\n  m(): { a: string } { return { a: '' }; }\n}\n", ("class::C class 0 2", "class::C::method::m method 1 1")),
    ("a.ts", "class R<T = {}> extends Base<T> {\n  constructor(private x: T) { super(); }\n}\n", ("class::R class 0 2", "class::R::method::constructor method 1 1")),
    ("a.ts", "class A {\n  @Input() set(v: number) { this.v = v; }\n  @dec() m(a, b) {}\n  @HostListener('x', ['$event']) on(e) {}\n}\n",
     ("class::A class 0 4", "class::A::method::set method 1 1", "class::A::method::m method 2 2", "class::A::method::on method 3 3")),
    ("a.ts", "class A {} export class B {}\n", ("class::A class 0 0", "class::B class 0 0")),
    ("a.ts", "let a = 1; function c() {}\n", ("function::c function 0 0",)),
    ("a.tsx", "export function A() {\n  return <p>it's</p>; }\nfunction b() {}\n", ("function::A function 0 1", "function::b function 2 2")),
    ("a.tsx", "const A = () => (\n  <ul>{xs.map((x) => <li key={x}>don't {x} </li>)}</ul>\n);\nclass B { m() {} }\n",
     ("function::A function 0 2", "class::B class 3 3", "class::B::method::m method 3 3")),
    ("a.tsx", "const f = <T,>(x: T) => x;\nconst g = <T extends {}>(x: T): T => { return x; };\nfunction h() {}\n", ("function::f function 0 0", "function::g function 1 1", "function::h function 2 2")),
    ("a.jsx", "const v = <A on={() => { f('}') }} b=\"}\" />;\nexport const W = () => <><B/>'</>;\nfunction h() {}\n", ("function::W function 1 1", "function::h function 2 2")),
    ("a.ts", "const f = <T>(x: T) => x;\nconst n = <number>y;\nfunction g() {}\n", ("function::f function 0 0", "function::g function 2 2")),
    ("a.ts", "function f(): { a: string } {\n  return { a: '' };\n}\nfunction g(): void;\nfunction g(x?: number): void {}\n", ("function::f function 0 2", "function::g function 4 4")),
    ("a.ts", "type A = { a: string; b(): void }\ntype B<T> =\n  | { k: 'a' }\n  | T[];\ntype C = A extends B<1> ? X : Y;\nlet z = 1\n", ("type::A type 0 0", "type::B type 1 3", "type::C type 4 4")),
    ("a.ts", "export type F = (a: number) => { b: string };\nexport interface I<T = {}> extends J<{ x: 1 }>, K {\n  m(): void;\n}\n", ("type::F type 0 0", "interface::I interface 1 3")),
    ("a.ts", "export const enum E { A = 1, B }\nenum F {}\nnamespace N.M {\n  export function inner() {}\n}\nmodule.exports = {};\n", ("enum::E enum 0 0", "enum::F enum 1 1", "namespace::N.M namespace 2 4")),
    ("a.ts", "const a = 1, f = () => 2, g = function () {};\nvar h = async (x) => {\n  await x;\n}\nlet n = f(1);\n", ("function::f function 0 0", "function::h function 1 3")),
    ("a.js", "const o = {\n  f() {},\n  g: () => 1\n};\nconst k = (1 + 2) * f(() => { return 1; });\n", ()),
    ("a.ts", "class A {\n  x = () => { return 1; };\n  static #p = 1;\n  get v() { return 1; }\n  set v(x) {}\n  static async *gen() {}\n  #q() {}\n  [Symbol.iterator]() {}\n}\n",
     ("class::A class 0 8", "class::A::method::v method 3 3", "class::A::method::v#L4 method 4 4", "class::A::method::gen method 5 5", "class::A::method::#q method 6 6", "class::A::method::[Symbol.iterator] method 7 7")),
    ("a.ts", "class A {\n  catch(e) {}\n  delete(id: string): Promise<void> { if (x) { y(); } }\n  if() {}\n}\n",
     ("class::A class 0 4", "class::A::method::catch method 1 1", "class::A::method::delete method 2 2", "class::A::method::if method 3 3")),
    ("a.ts", "class A {\n  m() {\n    return { run() { return 1; }, x: 2 };\n  }\n}\n", ("class::A class 0 4", "class::A::method::m method 1 3", "class::A::method::run method 2 2")),
    ("a.ts", "function make() {\n  class Inner {\n    go() {}\n  }\n  return Inner;\n}\n", ("function::make function 0 5", "class::Inner::method::go method 2 2")),
    ("a.ts", "@Component({ selector: 'a', template: `<b>{{x}}</b>` })\nexport class A {\n  m() {}\n}\n", ("class::A class 0 3", "class::A::method::m method 2 2")),
    ("a.ts", "export default class {\n  m() {}\n}\n", ("class::default class 0 2", "class::default::method::m method 1 1")),
    ("a.ts", "export default class A extends mixin(B, C) {\n  override m<T>(x: T): x is T & { a: 1 } { return true; }\n}\n", ("class::A class 0 2", "class::A::method::m method 1 1")),
    ("a.ts", "abstract class A {\n  abstract a(): void;\n  b(): void {}\n}\n", ("class::A class 0 3", "class::A::method::b method 2 2")),
    ("a.js", "const re = /[{\"']/g, t = `a ${b ? `{${c}` : '}'} {`;\nfunction f() { return x / 2 / y; }\n", ("function::f function 1 1",)),
    ("a.js", "if (x) /}}/.test(s)\nfunction f() {}\nx = a\n/b/g\nfunction g() {}\n", ("function::f function 1 1", "function::g function 4 4")),
    ("a.js", "export { a } from './a'\nexport * from './b'\nexport async function f() {}\nexport let x = 1\nexport const y = function named() {}\n", ("function::f function 2 2", "function::y function 4 4")),
    ("a.js", "foo(function () {\n  function inner() {}\n});\nvar A = class {\n  m() {}\n};\n", ("class::A class 3 5", "class::A::method::m method 4 4")),
    ("a.ts", "const a = b as Map<string, { c: number }>\nconst d = e satisfies F\nfunction g() {}\n", ("function::g function 2 2",)),
    ("a.ts", "let x: { a: () => void } = { a() {} };\nconst y: Array<{ b: 1 }> = [];\nconst z: (q: number) => string = (q) => `${q}`;\n", ("function::z function 2 2",)),
    ("a.ts", "const f = (a: { b: number } = { b: 1 }): Promise<{ c: 1 }> => {\n  return a;\n};\n", ("function::f function 0 2",)),
    ("a.ts", "class A { private readonly m = new Map<string, () => void>(); run(): void { for (const x of this.m) { x(); } } }\n", ("class::A class 0 0", "class::A::method::run method 0 0")),
    ("a.ts", "// class Fake {}\n/* function no() { */\nconst s = 'class X {';\nclass Real {}\n", ("class::Real class 3 3",)),
    ("a.ts", "function broken( {\nclass A {}\n", ()),
    ("a.phtml", "<?php class A { function m() {} } ?>\n<p><?= $x ?></p>\n", ()),
    ("A.java", "package a;\n@Entity(name = \"x{\")\npublic final class A<T extends Comparable<T>> extends B<T> implements C {\n  private int n = f();\n  public A() { super(); }\n  @Override\n  public String toString() { return \"}\"; }\n}\n",
     ("class::A class 1 7", "class::A::method::toString method 5 6")),
    ("A.java", "interface I {\n  void a();\n}\nenum E { X { void z() {} }, Y; void b() {} }\n@interface N { int v(); }\nrecord P(int x) { int y() { return x; } }\n", ("interface::I interface 0 2", "enum::E enum 3 3")),
    ("A.java", "abstract class A {\n  abstract void a();\n  <T> List<T> b(int[] x) throws E { return new C() { public void run() {} }; }\n  static { x(); }\n  enum K { P, Q; int r() { return 1; } }\n  class D { int[] s() { return null; } }\n}\n",
     ("class::A class 0 6", "class::A::method::a method 1 1", "class::A::method::b method 2 2", "class::A::method::run method 2 2", "class::A::method::r method 4 4", "class::D::method::s method 5 5")),
    ("A.java", "class A {\n  Runnable r = () -> { go(); };\n  int[] xs = {1, 2};\n  String t = \"\"\"\n    class B { void no() {} }\n    \"\"\";\n  void m() { if (x) { y(); } else { z(); } }\n}\nclass C {}\n",
     ("class::A class 0 7", "class::A::method::m method 6 6", "class::C class 8 8")),
    ("a.ts", "export class A<in out T> { m() {} } class B { n() {} }\n", ("class::A class 0 0", "class::A::method::m method 0 0", "class::B class 0 0", "class::B::method::n method 0 0")),
    ("a.mjs", "export const handler = async (event) => ({ statusCode: 200 })\nexport default handler\nfunction tail() {}\n", ("function::handler function 0 0", "function::tail function 2 2")),
    ("a.tsx", "class V extends React.Component<{ a: string }, {}> {\n  render() { return <a href=\"x\" {...p}>{this.props.a} isn't {'}'}</a> }\n  state = {}\n}\n", ("class::V class 0 3", "class::V::method::render method 1 1")),
)
