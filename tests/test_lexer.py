"""Declarations with scopes, body ranges and calls by caller; nothing is read from comments and strings."""

import time

import pytest

from lodestone.sources.lexer import analysed, blanked, calls, parsed, quiet_spans, symbols


def _symbols(language, content):
    return {(r[1], r[3]) for r in analysed(language, content) if r[0] == "symbol"}


def _calls(language, content):
    return {(r[10], r[2], r[11], r[12]) for r in analysed(language, content) if r[0] == "call"}


RUST = '''
// fn not_one() {}
/* outer /* fn inner() {} */ fn still() {} */
pub struct Container<T> { x: T }
impl<T> Container<T> where T: Clone {
    pub fn new(x: T) -> Self { helper("fn fake() { call() }"); Self { x } }
    pub fn get(&self) -> &T { self.x.clone(); &self.x }
}
impl Greet for Greeter { fn greet(&self) -> String { text(r#"a " fn z() { never()"#) } }
pub mod outer { pub fn helper() {} pub mod inner { pub fn helper() {} } }
trait Named { fn name(&self) -> String; }
fn lifetimes<'a>(x: &'a str) -> char { let c = '{'; for i in 0..3 { go::<u8>(i); } c }
'''
PYTHON = '''import os
# def no(): pass
class Outer(Base):
    """Doc of
    Outer."""
    def method(self,
               a=")"):
        x = """
def hidden(): call()
"""
        return run(self.go(1))

    class Inner:
        async def deep(self): return [
            f(1)
        ]

def last():
    pass
top()
'''
TYPESCRIPT = '''export class Shape<T> extends Base {
  private x = "function no() { bad() }";
  constructor(a: number) { super(a); }
  area(): number { if (x) { foo(`${bar()}`); } return this.calc(1); }
}
/** Adds. */
export function add(a: number, b = { c: 1 }): number {
  return go(function () { return inner(1); });
}
export const Made = class { area() { return 1; } };
interface Named { name(): string }
'''
GO = '''package main
import (
	"fmt"
)
// Greeter holds `x`.
type Greeter struct {
	Name string
}
type Namer interface {
	GetName() string
}
const Max = 3
// Greet greets.
func Greet(name string) string {
	return fmt.Sprintf(`func no() { ` + "Hello(", name)
}
func (g *Greeter) GetName() string { return g.Name }
'''
JAVA = '''package p;
/** Holds. */
public final class M {
  private static int size(int a) { return Math.max(a, 1); } // int no() { bad(); }
  public M() { init("{"); }
  abstract void later();
  class Inner { void go() { for (int i = 0; i < 3; i++) { step(i); } } }
}
'''


def test_rust():
    assert _symbols("rust", RUST) == {("class", "Container"), ("method", "Container::new"), ("method", "Container::get"), ("method", "Greeter::greet"), ("module", "outer"), ("function", "helper"), ("module", "inner"), ("trait", "Named"), ("function", "lifetimes")}
    assert sum(r[3] == "helper" for r in analysed("rust", RUST) if r[0] == "symbol") == 2
    assert _calls("rust", RUST) == {(None, "helper", False, "Container::new"), ("x", "clone", True, "Container::get"), (None, "text", False, "Greeter::greet"), (None, "go", False, "lifetimes")}


def test_python():
    assert _symbols("python", PYTHON) == {("class", "Outer"), ("method", "Outer::method"), ("class", "Outer::Inner"), ("method", "Outer::Inner::deep"), ("function", "last")}
    assert _calls("python", PYTHON) == {(None, "run", False, "Outer::method"), ("self", "go", True, "Outer::method"), (None, "f", False, "Outer::Inner::deep"), (None, "top", False, None)}
    by_name = {r[3]: r for r in analysed("python", PYTHON) if r[0] == "symbol"}
    assert by_name["Outer"][9] == "Doc of Outer." and by_name["Outer::method"][8] == 'def method(self, a=")")'
    body = PYTHON.encode()[by_name["Outer::method"][5] : by_name["Outer::method"][6]].decode()
    assert body.startswith("def method(self,") and body.endswith("return run(self.go(1))")


def test_typescript():
    assert _symbols("typescript", TYPESCRIPT) == {("class", "Shape"), ("method", "Shape::constructor"), ("method", "Shape::area"), ("function", "add"), ("class", "Made"), ("method", "Made::area"), ("interface", "Named"), ("method", "Named::name")}
    assert _calls("typescript", TYPESCRIPT) == {(None, "super", False, "Shape::constructor"), (None, "foo", False, "Shape::area"), ("this", "calc", True, "Shape::area"), (None, "go", False, "add"), (None, "inner", False, "add")}


def test_go_and_java():
    assert _symbols("go", GO) == {("class", "Greeter"), ("interface", "Namer"), ("constant", "Max"), ("function", "Greet"), ("method", "GetName")}
    assert _calls("go", GO) == {("fmt", "Sprintf", True, "Greet")}
    assert {r[9] for r in analysed("go", GO) if r[0] == "symbol"} == {"Greeter holds `x`.", "Greet greets.", None}
    assert _symbols("java", JAVA) == {("class", "M"), ("method", "M::size"), ("method", "M::M"), ("method", "M::later"), ("class", "M::Inner"), ("method", "M::Inner::go")}
    assert _calls("java", JAVA) == {("Math", "max", True, "M::size"), (None, "init", False, "M::M"), (None, "step", False, "M::Inner::go")}


@pytest.mark.parametrize("language", ["rust", "python", "typescript", "go", "java", "kotlin", "csharp", "php", "c", "cpp", "swift", "dart"])
@pytest.mark.parametrize("content", ["", "{", "}}}", "((((", "/* never ends", '"""', "'", "fn f(", "class A {", "é" * 50 + "\n", "def f():", "[" * 5000, "{" * 5000, "impl", "\x00\x01"])
def test_malformed_sources_give_what_can_be_read(language, content):
    analysed(language, content)
    assert len(blanked(content, quiet_spans(content, language))) == len(content)


def test_time_grows_with_the_length():
    for language, unit in (("rust", "fn f() { g(1); }\n"), ("python", "def f():\n    g('x')\n"), ("typescript", "class A { m() { g({a: [1, 2]}); } }\n"), ("go", "type T struct { A int }\n"), ("rust", "a" * 50)):
        start = time.time()
        analysed(language, unit * (1_000_000 // len(unit)))
        assert time.time() - start < 60, language


def test_places_are_bytes_and_rows_come_by_path(spark):
    content = "// é\nfn a() { b(\"ü\") }\n"
    df = spark.createDataFrame([("src/a.rs", content), ("notes.txt", "fn no() {}"), ("src/none.rs", None), ("src/empty.rs", "")], "path string, content string")
    found = symbols(parsed(df)).collect()
    assert [(r.path, r.qualified_name, r.visibility, content.encode()[r.start_byte : r.end_byte].decode()) for r in found] == [("src/a.rs", "a", "private", 'fn a() { b("ü") }')]
    assert [(r.path, r.name, r.caller, r.caller_hash) for r in calls(parsed(df)).collect()] == [("src/a.rs", "b", "a", found[0].body_hash)]
