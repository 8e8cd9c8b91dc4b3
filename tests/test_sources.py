import subprocess

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from threadloom.api import CodeIndex
from threadloom.operators.coupling import god_structs
from threadloom.operators.index import build_index, compact, current, prune, publish, published, run_counters, update_files, update_index
from threadloom.operators.render import as_json, as_markdown
from threadloom.operators.lookup import callees, callers, dispatch_sites, struct_fields, unused_symbols
from threadloom.operators.search import semantic_search
from threadloom.sources import git
from threadloom.sources.extract import generated, is_test_name, is_test_path, read_code, references, symbols
from threadloom.sources.manifest import manifest_symbols
from threadloom.sources.paths import relative_path, safe_join
from threadloom.sources.scan import indexed, scan_tree, unsupported_types
from threadloom.streaming.events import stream_index
from threadloom.streaming.watch import Watcher


def files(spark, **contents):
    rows = [(p.replace("__", "/").replace("_dot_", "."), c) for p, c in contents.items()]
    from threadloom.sources.scan import language

    return spark.createDataFrame(rows, "path string, content string").withColumn("content_hash", F.sha2("content", 256)).withColumn("language", language(F.col("path")))


MANIFESTS = {
    "package.json": ('{"private": true, "scripts": {"lint": "check --all src"}, "peerDependencies": {"loom": ">=2 <4"}, "optionalDependencies": {"shuttle": "file:../shuttle"}, "name": "@mill/bobbin"}', {("module", "@mill/bobbin", None), ("import", "loom", "peerDependencies: >=2 <4"), ("import", "shuttle", "optionalDependencies: file:../shuttle"), ("function", "lint", "check --all src")}),
    "Cargo.toml": ('[workspace]\nmembers = ["x"]\n\n[package]\nedition = "2021"\nversion = "2.4.0-rc.1"\nname = "tin_drum"\n\n[build-dependencies]\nsolder = "0.3"\n\n[dependencies.brass]\npath = "../brass"\nversion = "5"\n', {("module", "tin_drum", "tin_drum@2.4.0-rc.1"), ("import", "solder", "build-dependencies: 0.3"), ("import", "brass", "dependencies: 5")}),
    "go.mod": ("module example.com/m\n\ngo 1.21\n\nrequire (\n\tcode.example/a/b v1.2.3 // indirect\n\tgithub.com/c/d v0.1.0\n)\nrequire github.com/e/f v2.0.0\n", {("module", "example.com/m", None), ("constant", "go", "1.21"), ("import", "code.example/a/b", "v1.2.3"), ("import", "github.com/c/d", "v0.1.0"), ("import", "github.com/e/f", "v2.0.0")}),
    "a/pyproject.toml": ('[project]\nname = "p"\nversion = "1"\ndependencies = [\n  "kettle>=2",\n  "courier[socks] ~= 2.0; python_version > \'3\'",\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n', {("module", "p", "p@1"), ("import", "kettle", ">=2"), ("import", "courier", "~= 2.0"), ("import", "pytest", None)}),
    "b/pyproject.toml": ('[tool.poetry]\nname = "q"\nversion = "2"\n[tool.poetry.dependencies]\npython = "^3.9"\nkettle = "^2"\n[tool.poetry.group.dev.dependencies]\nblack = {version = "23"}\n', {("module", "q", "q@2"), ("import", "kettle", "^2"), ("import", "black", "23")}),
    "requirements.txt": ("# c\n-r other.txt\n\nkettle==2.0\ncourier\n", {("import", "kettle", "==2.0"), ("import", "courier", None)}),
    "Gemfile": ('source "https://rubygems.org"\nruby "3.2"\ngem "trellis", "~> 7"\ngem \'pg\'\n', {("constant", "source", "https://rubygems.org"), ("constant", "ruby", "3.2"), ("import", "trellis", "~> 7"), ("import", "pg", None)}),
    "composer.json": ('{"name": "v/app", "require": {"php": ">=8"}, "require-dev": {"birch/leaf": "10"}, "scripts": {"test": "leafrun"}}', {("module", "v/app", None), ("import", "php", "require: >=8"), ("import", "birch/leaf", "require-dev: 10"), ("function", "test", "leafrun")}),
    "pom.xml": ("<project><groupId>com.example</groupId><artifactId>fernhill</artifactId><version>1.0</version><dependencies><dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4</version><scope>test</scope></dependency></dependencies><build><plugins><plugin><artifactId>compiler</artifactId><version>3</version></plugin></plugins></build></project>", {("module", "com.example:fernhill", "com.example:fernhill@1.0"), ("import", "junit:junit", "test: 4"), ("import", "compiler", "plugin: 3")}),
    "build.gradle": ("plugins {\n  id 'java'\n  id 'org.spring' version '3.0'\n}\ngroup = 'com.example'\ndependencies {\n  implementation 'a.b:c:1.0'\n  testImplementation(\"d.e:f\")\n}\n", {("import", "java", None), ("import", "org.spring", "plugin: 3.0"), ("module", "com.example", None), ("import", "a.b:c", "implementation: 1.0"), ("import", "d.e:f", None)}),
    "build.sbt": ('ThisBuild / organization := "mill"\nscalaVersion := "2.13.14"\nname := "harrow"\nlibraryDependencies ++= Seq(\n  "soil" %% "loam" % "4.2.1",\n  "soil" % "clay" % "1" % Test,\n)\n', {("module", "harrow", None), ("constant", "scalaVersion", "2.13.14"), ("import", "soil:loam", "4.2.1"), ("import", "soil:clay", "1")}),
    "bad/package.json": ("{not json", set()),
    "bad/Cargo.toml": ("= = [", set()),
}


def test_manifests(spark):
    df = spark.createDataFrame([(p, c) for p, (c, _) in MANIFESTS.items()], "path string, content string")
    got: dict = {p: set() for p in MANIFESTS}
    for r in manifest_symbols(df).collect():
        got[r.path].add((r.kind, r.name, r.signature))
    for path, (_, want) in MANIFESTS.items():
        assert got[path] == want, path


PYTHON = """from tides import (
    moon,
    sun as star,
)

TEMPLATE = \'\'\'
def not_code():
    pass
\'\'\'


def tide(day,
         *, offset=0):
    "Height of the water."

    def wave(x):
        return moon(x) + offset

    return wave(day.hour)


class Buoy:
    depth = 3

    async def report(self, to): to.depth = tide(self.depth)
"""
RUST = """use std::collections::BTreeMap;
use crate::grid::{Cell, Row as Line};

pub trait Load {
    fn load(&self) -> u32;
}

pub struct Shelf<'s> {
    pub label: &'s str,
    books: Vec<Book>,
}

impl<'s> Load for Shelf<'s> {
    fn load(&self) -> u32 {
        weigh(&self.books) / self.label.len() as u32
    }
}

/* fn ghost() { /* nor here */ weigh() }
   fn other() {} */

/// Empties a shelf,
/// whatever it holds.
pub(crate) fn restock<'a>(
    shelf: &'a mut Shelf,
    level: Level,
) -> bool {
    shelf.books.clear();
    let text = r#"fn quoted() { "{" "#;
    match level {
        Level::Empty => true,
        Level::Half | Level::Full => { false }
    }
}

fn weigh(books: &[Book]) -> u32 { books.len() as u32 } fn beside() { restock() }
"""
SCRIPT = """import {
  ferry, harbor as port
} from './water';
import Lock from '../lock';

/* class Sunk {} */
export abstract class Barge<T> extends Hull {
  #load = 0
  readonly name: string;
  constructor(private size: number) { super(); }
  get load() { return this.#load }
  async sail(to: Port,
             via?: Lock): Promise<void> {
    await ferry(`from ${port(this.name)} { to`, () => {
      to.open = true
    });
  }
  abstract sink(): void;
}
const crew = { cook() { return stew() }, mate: (x) => x }
interface Tug { pull(b: Barge<any>): boolean; horns: number }
namespace Deep.Sea { export type Knot = number }
export default function* log() {}
"""


def found(spark, path, content):
    code = read_code(spark.createDataFrame([(path, content)], "path string, content string"))
    rows = symbols(code).cache()
    return {(r.kind, r.name): r for r in rows.collect()}, {(r.kind, r.reference_name, r.detail) for r in references(code, rows).collect()}


def spans(found):
    return {k: (v.start_line, v.end_line) for k, v in found.items()}


def test_python_symbols(spark):
    s, r = found(spark, "tide.py", PYTHON)
    assert spans(s) == {("import", "moon"): (1, 4), ("function", "tide"): (12, 19), ("function", "wave"): (16, 17), ("class", "Buoy"): (22, 25), ("function", "report"): (25, 25)}
    assert (s["function", "tide"].docstring, s["function", "wave"].docstring, s["function", "tide"].signature) == ('"Height of the water."', None, "def tide(day,")
    assert s["function", "report"].is_async
    assert r == {("imports", "star", None), ("calls", "moon", None), ("calls", "wave", None), ("calls", "tide", None), ("accesses", "hour", None), ("accesses", "depth", None), ("mutates", "depth", None)}


def test_rust_symbols(spark):
    s, r = found(spark, "src/shelf.rs", RUST)
    assert spans(s) == {("interface", "Load"): (4, 6), ("struct", "Shelf"): (8, 11), ("field", "label"): (9, 9), ("field", "books"): (10, 10), ("function", "load"): (14, 16), ("function", "restock"): (24, 34), ("function", "weigh"): (36, 36), ("function", "beside"): (36, 36)}
    assert {k[1]: v.visibility for k, v in s.items()} == {"Load": "public", "Shelf": "public", "label": "public", "books": "private", "load": "private", "restock": "public", "weigh": "private", "beside": "private"}
    assert (s["function", "restock"].docstring, s["function", "restock"].signature, s["function", "beside"].signature) == ("Empties a shelf,\nwhatever it holds.", "pub(crate) fn restock<'a>(", "fn beside()")
    assert {x for x in r if x[0] != "accesses"} == {("calls", "weigh", None), ("calls", "len", None), ("calls", "clear", None), ("calls", "restock", None), ("mutates", "Shelf", "mut_param"), ("references", "Empty", "dispatch"), ("references", "Half", "dispatch"), ("references", "Full", "dispatch"), ("imports", "BTreeMap", None), ("imports", "Line", None)}
    assert {x[1] for x in r if x[0] == "accesses"} == {"books", "label"}


def test_script_symbols(spark):
    s, r = found(spark, "barge.ts", SCRIPT)
    assert spans(s) == {("import", "Lock"): (4, 4), ("class", "Barge"): (7, 19), ("field", "#load"): (8, 8), ("field", "name"): (9, 9), ("method", "constructor"): (10, 10), ("method", "load"): (11, 11), ("method", "sail"): (12, 17), ("method", "sink"): (18, 18), ("method", "cook"): (20, 20), ("interface", "Tug"): (21, 21), ("method", "pull"): (21, 21), ("field", "horns"): (21, 21), ("module", "Deep.Sea"): (22, 22), ("type_alias", "Knot"): (22, 22), ("function", "log"): (23, 23)}
    assert (s["method", "sail"].is_async, s["class", "Barge"].is_exported, s["field", "name"].visibility) == (True, True, "private")
    assert {x for x in r if x[0] == "calls"} == {("calls", "ferry", None), ("calls", "port", None), ("calls", "stew", None)}
    assert ("mutates", "open", None) in r
    assert {x[1] for x in r if x[0] == "imports"} == {"water", "lock"}
    assert found(spark, "empty.rs", "") == ({}, set())


GO = """package quay

import (
\t"net/rope"
\tcrane "example.com/lift"
)

type (
\tBerth struct {
\t\tdepth int
\t}
\tTonnes = float64
\tMooring interface {
\t\tTie(to Berth) error
\t}
)

const (
\tSlack = iota
\tTaut
)

func (b *Berth) Dredge(
\tby Tonnes,
) error {
\ts := `func raw() {`
\treturn rope.Pull(s)
}
"""
JAVA = """package port.yard;

import java.util.Map;

/** Counts boxes. */
@Entity(name = "stack")
public class Stack<T extends Box> {
    private static final int HEIGHT = 5, WIDTH = 2;
    private final Map<String, Integer> rows = new TreeMap<>(order());

    public Stack(int height) { this.clear(height); }

    // int old() { return 0; }
    @Override
    public <K> Map<K, Integer>
            tally(Map<K, Integer> into,
                  int limit)
            throws YardException
    {
        if (limit > 0) { into.put(key(), HEIGHT); }
        String s = \"\"\"
            int texted() { return 1; }
            \"\"\";
        return into;
    }

    int one() { return one(); }

    enum Side { PORT(1), STAR(2); int code() { return ordinal(); } }

    interface Lid { boolean shut(); }
}
"""
C = """#include <anchor.h>
#define FATHOM 6
#define DEEP(x) \\
    ((x) * FATHOM)

typedef struct chain { int links; } chain_t;
typedef void (*on_drop)(int depth);

int drop(chain_t *c, int depth);

static chain_t *
forge(int links,
      const char *name)
{
    /* int rust(void) { } */
    return cast(links, '{');
}

enum state { UP, DOWN };
"""
CPP = """namespace dock::inner {
class Winch final : public Gear {
public:
    explicit Winch(int power) : Gear(power) {}
    ~Winch();
    int pull() const { return haul(power_); }
private:
    int power_;
};
using Load = std::vector<int>;
template <typename T>
T heavier(T a, T b) { return pick(a, b); }
int Winch::brake(int by)
{
    auto s = R"x(int raw() { )x";
    return slow(by);
}
}
"""
CSHARP = """using System;
namespace Fleet.Radio {
    public record Call(string Sign);
    public delegate void Heard(int channel);
    public class Mast {
        private const int Height = 30;
        public int Range { get; set; }
        [Obsolete("no { brace")]
        public async Task<int> Send(Call c,
            int channel) => await Relay(c, channel);
        public Mast(int range) { Tune(range); }
    }
}
"""
OTHERS = {
    "quay.go": (GO, {("module", "quay"): (1, 1), ("import", "crane"): (5, 5), ("struct", "Berth"): (9, 11), ("type_alias", "Tonnes"): (12, 12), ("interface", "Mooring"): (13, 15), ("constant", "Slack"): (19, 19), ("constant", "Taut"): (20, 20), ("method", "Dredge"): (23, 28)}, {"Pull"}, {"rope", "lift"}),
    "Stack.java": (JAVA, {("module", "port.yard"): (1, 1), ("class", "Stack"): (7, 32), ("constant", "HEIGHT"): (8, 8), ("constant", "rows"): (9, 9), ("method", "Stack"): (11, 11), ("method", "tally"): (15, 25), ("method", "one"): (27, 27), ("enum", "Side"): (29, 29), ("method", "code"): (29, 29), ("interface", "Lid"): (31, 31), ("method", "shut"): (31, 31)}, {"order", "clear", "put", "key", "one", "ordinal", "TreeMap"}, {"Map"}),
    "anchor.c": (C, {("constant", "FATHOM"): (2, 2), ("struct", "chain"): (6, 6), ("type_alias", "chain_t"): (6, 6), ("type_alias", "on_drop"): (7, 7), ("function", "forge"): (11, 17), ("enum", "state"): (19, 19)}, {"cast"}, {"h"}),
    "winch.cpp": (CPP, {("module", "dock::inner"): (1, 18), ("class", "Winch"): (2, 9), ("function", "Winch"): (4, 4), ("function", "pull"): (6, 6), ("type_alias", "Load"): (10, 10), ("function", "heavier"): (11, 12), ("function", "brake"): (13, 17)}, {"Gear", "haul", "pick", "slow"}, set()),
    "Mast.cs": (CSHARP, {("import", "System"): (1, 1), ("module", "Fleet.Radio"): (2, 13), ("class", "Call"): (3, 3), ("type_alias", "Heard"): (4, 4), ("class", "Mast"): (5, 12), ("constant", "Height"): (6, 6), ("method", "Send"): (9, 10), ("method", "Mast"): (11, 11)}, {"Relay", "Tune"}, {"System"}),
    "keel.kt": ("package ship.keel\n\nconst val DRAFT = 4\ntypealias Beam = Int\n\nclass Keel(val wood: Wood) : Part() {\n    fun <T> bend(by: T): T =\n        steam(by)\n    companion object { fun of(w: Wood) = Keel(w) }\n}\n", {("module", "ship.keel"): (1, 1), ("constant", "DRAFT"): (3, 3), ("type_alias", "Beam"): (4, 4), ("class", "Keel"): (6, 10), ("function", "bend"): (7, 8), ("function", "of"): (9, 9)}, {"Part", "steam", "Keel"}, set()),
    "Sail.scala": ("package ship.sail\n\nsealed trait Cloth { def area: Int }\ncase class Jib(w: Int) extends Cloth {\n  val luff = cut(w)\n  type Thread = String\n  def area =\n    luff.size\n}\nobject Jib { def apply(): Jib = sew(1) }\n", {("module", "ship.sail"): (1, 1), ("interface", "Cloth"): (3, 3), ("class", "Jib"): (10, 10), ("constant", "luff"): (5, 5), ("type_alias", "Thread"): (6, 6), ("function", "area"): (7, 8), ("function", "apply"): (10, 10)}, {"cut", "sew"}, set()),
    "knot.rb": ("require 'rope'\n\nmodule Knots\n  class Bowline < Knot\n    TURNS = 2\n    # Ties it.\n    def self.tie(rope)\n      loop_over(rope) if rope\n      <<~TEXT\n        def heredoc\n        end\n      TEXT\n    end\n  end\nend\n", {("interface", "Knots"): (3, 15), ("class", "Bowline"): (4, 14), ("constant", "TURNS"): (5, 5), ("function", "tie"): (7, 13)}, {"loop_over"}, {"rope"}),
    "Deck.groovy": ("package ship\n\ndef swab(times) {\n  scrub(times)\n}\nclass Deck {\n  int planks = 9\n  def caulk() { swab(planks) }\n}\n", {("module", "ship"): (1, 1), ("function", "swab"): (3, 5), ("class", "Deck"): (6, 9), ("constant", "planks"): (7, 7), ("method", "caulk"): (8, 8)}, {"scrub", "swab"}, set()),
    "hull.js": ("const rivet = async function pound() { hit(/[/{]/g) }\nclass Hull { paint(c) { this.color = c } static build() { return new Hull() } }\nmodule.exports = { launch({ at }) { slide(at) } }\n", {("function", "pound"): (1, 1), ("class", "Hull"): (2, 2), ("method", "paint"): (2, 2), ("method", "build"): (2, 2), ("method", "launch"): (3, 3)}, {"hit", "Hull", "slide"}, set()),
}


def test_symbols_of_other_languages(spark):
    code = read_code(spark.createDataFrame([(p, x[0]) for p, x in OTHERS.items()], "path string, content string"))
    rows = symbols(code).cache()
    got, refs = rows.collect(), references(code, rows).collect()
    for path, (_, want, calls, imports) in OTHERS.items():
        assert {(r.kind, r.name): (r.start_line, r.end_line) for r in got if r.path == path} == want, path
        assert {r.reference_name for r in refs if r.path == path and r.kind == "calls"} == calls, path
        assert {r.reference_name for r in refs if r.path == path and r.kind == "imports"} == imports, path
    java = {r.name: r for r in got if r.path == "Stack.java"}
    assert (java["HEIGHT"].visibility, java["tally"].visibility, java["one"].visibility) == ("private", "public", "unknown")


def test_what_is_no_code_keeps_its_place():
    from threadloom.sources.lexer import NO_CODE, blanked, statements

    odd = ["", '"', "'", "`", "/*", '"""', "`${`${`", "{{{", "}}}", ")]}", "a = `x ${ {b: `y ${c}`} } z` + d", "r#\"", "/* /* */", "#define \\\n", "<<EOS\nx", "x = \"a\\\"b\" // c", "\\", "é\u2028\"ü\n"]
    odd += ["".join(p) for p in zip(odd, reversed(odd), strict=True)]
    for language in NO_CODE:
        for text in odd:
            code = blanked(text, language)
            assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
            for s in statements(code, language):
                assert 1 <= s[2] <= s[3] <= text.count("\n") + 1
                assert s[1] is None or s[1] < s[0]
    assert blanked("a `x ${f(`y ${g()}`)} z` b", "typescript").split() == ["a", "f(", "g()", ")", "b"]


SHAPES = """use std::fmt;
use slab;

/// A place
/// on the plane.
#[derive(Clone)]
pub struct Point { pub x: i32, y: HashMap<String, Vec<u8>> }

// What there is.
pub enum Kind {
    Dot,
    Line(Point, Point), Arc = 4,
    Ring {
        radius: f64,
    },
}

struct Empty;

mod checks {
    #[test]
    fn works() {
        assert_eq!(1, sum(1));
    }

    #[test] fn also() { sum(2); }

    fn helper() {}
}

fn sum(k: Kind) -> i32 {
    match k {
        Kind::Dot | Kind::Arc => {
            other()
        }
        crate::Kind::Line(..) => 2,
    }
}

async fn later(a: i32,
    b: i32) {
    done();
}
"""


def test_members_imports_and_attributes(spark):
    s, r = found(spark, "src/shapes.rs", SHAPES)
    want = {("import", "slab"): (2, 2), ("struct", "Point"): (7, 7), ("field", "x"): (7, 7), ("field", "y"): (7, 7), ("enum", "Kind"): (10, 16), ("enum_member", "Dot"): (11, 11), ("enum_member", "Line"): (12, 12), ("enum_member", "Arc"): (12, 12), ("enum_member", "Ring"): (13, 15), ("field", "radius"): (14, 14), ("struct", "Empty"): (18, 18), ("module", "checks"): (20, 29), ("function", "works"): (22, 24), ("function", "also"): (26, 26), ("function", "helper"): (28, 28)}
    want |= {("function", "sum"): (31, 38), ("function", "later"): (40, 43)}
    assert {k: (v.start_line, v.end_line) for k, v in s.items()} == want
    assert (s["field", "x"].visibility, s["field", "y"].visibility) == ("public", "private")
    assert s["enum", "Kind"].docstring == "What there is."
    assert s["struct", "Point"].docstring is None  # an attribute stands between
    assert {k[1]: v.is_test for k, v in s.items() if k[0] == "function"} == {"works": True, "also": True, "helper": False, "sum": False, "later": False}
    assert [v.is_async for v in (s["function", "later"], s["function", "sum"])] == [True, False]
    assert (s["enum", "Kind"].signature, s["struct", "Empty"].signature) == (None, "struct Empty;")
    assert {x[1] for x in r if x[2] == "dispatch"} == {"Dot", "Arc", "Line"}
    assert ("calls", "assert_eq", None) in r
    script = "import Base, { other } from 'base';\nenum Tone {\n  Low = 1,\n  High = 'h',\n}\nclass Bell {\n  private size: number = 2;\n  name?: string;\n  ring() {\n    return this.size;\n  }\n}\ninterface Box { width: number; readonly height: number }\n"
    s, _ = found(spark, "bell.ts", script)
    assert set(s) == {("import", "Base"), ("enum", "Tone"), ("enum_member", "Low"), ("enum_member", "High"), ("class", "Bell"), ("field", "size"), ("field", "name"), ("method", "ring"), ("interface", "Box"), ("field", "width"), ("field", "height")}
    assert s["field", "size"].visibility == "private"
    python = 'def outer():\n    """One.\n\n    Two def hidden(): pass\n    """\n    def inner():\n        pass\n\n\n# About it.\nclass K:\n    pass\n'
    s, _ = found(spark, "k.py", python)
    assert {k: (v.start_line, v.docstring) for k, v in s.items()} == {("function", "outer"): (1, '"""One.\nTwo def hidden(): pass\n"""'), ("function", "inner"): (6, None), ("class", "K"): (11, "# About it.")}


def test_catalogue_over_members(spark):
    g = build_index(files(spark, src__shapes_dot_rs=SHAPES, src__use_dot_rs="fn paint(k: Kind) {\n    match k {\n        Kind::Ring { .. } => {}\n    }\n}\n"))
    assert sorted(r["name"] for r in struct_fields(g, "Point").collect()) == ["x", "y"]
    assert {r.file_path: r.members for r in dispatch_sites(g, "Kind").collect()} == {"src/shapes.rs": ["Arc", "Dot", "Line"], "src/use.rs": ["Ring"]}
    assert {(r["name"], r.pub_fields, r.total_fields) for r in god_structs(g, None, 20).collect()} >= {("Point", 1, 2)}
    names = {r["name"]: r.qualified_name for r in g.nodes.where("kind IN ('function', 'field', 'enum_member')").collect()}
    assert (names["works"], names["Ring"], names["x"]) == ("checks::works", "Kind::Ring", "Point::x")
    kinds = {(r.kind, r.n) for r in g.edges.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert ("tests", 2) in kinds  # both tests call sum
    assert "sum" not in {r["name"] for r in unused_symbols(g).collect()}
    counted = Observation()
    g = build_index(files(spark, src__shapes_dot_rs=SHAPES, bad_dot_rs=None), counted)
    got = {r["name"]: r["count"] for r in run_counters(g, counted).collect()}
    assert (got["files"], got["nodes"], got["errors"], got["skipped"]) == (1, g.nodes.count(), 1, 0)
    assert got["edges"] == g.edges.count()
    assert got["resolved_refs"] == g.edges.where("kind NOT IN ('contains', 'tests')").count()


def test_a_long_file_costs_about_its_lines(spark):
    many = "\n".join(f"pub struct S{i} {{\n    a{i}: i32,\n}}\nimpl S{i} {{\n    fn f{i}(&self) {{\n        g{i}();\n    }}\n}}" for i in range(5000))
    g = build_index(files(spark, big_dot_rs=many))
    assert g.nodes.groupBy("kind").count().orderBy("kind").collect() == [("field", 5000), ("file", 1), ("function", 5000), ("struct", 5000)]
    assert g.refs.count() == 5000


def test_heuristics(spark):
    one = spark.range(1)
    name = lambda n: one.select(is_test_name(F.lit(n))).first()[0]
    assert [name(n) for n in ("tests", "Test", "test", "testHull", "test_", "HullTest", "hull_tests", "Testing", "tested", "fastest", "Testify", "latest_hull")] == [True] * 7 + [False] * 5
    path = lambda p: one.select(is_test_path(F.lit(p))).first()[0]
    assert [path(p) for p in ("test/hull.c", "lib/spec/Hull.scala", "hull_spec.rb", "web\\\\Tests\\\\x.cs", "a.spec.js", "testing/hull.c", "spec.js", "hulltest.go")] == [True] * 5 + [False] * 3
    mark = lambda c: one.select(generated(F.lit("a.go"), F.lit(c))).first()[0]
    assert [mark(c) for c in ("/* AUTO-GENERATED */ package a", "x" * 600 + " do not edit", "-- generated by hand", "degenerated")] == [True, False, True, False]


def shape(g):
    name = {r.id: (r.file_path, r["name"], r.start_line) for r in g.nodes.collect()}
    return sorted(name.values(), key=str), sorted(((name[r.source_id], name[r.target_id], r.kind, r.line) for r in g.edges.collect()), key=str)


def test_index_and_incremental_say_the_same(spark, tmp_path):
    first = files(spark, src__shelf_dot_rs=RUST, calc_dot_py=PYTHON, gone_dot_py="def lost():\n    weigh()\n")
    second = files(spark, src__shelf_dot_rs=RUST.replace("        weigh(&self", "        other(&self"), calc_dot_py=PYTHON, new_dot_py="def moon():\n    tide()\n")
    g = build_index(first)
    assert [r["name"] for r in callers(g, "weigh").collect()] == ["lost", "load"]
    assert [r["name"] for r in callees(g, "load").collect()] == ["weigh"]
    assert {r.qualified_name for r in g.nodes.where("file_path = 'src/shelf.rs' AND start_line = 36").collect()} == {"weigh", "beside"}
    only = update_files(g, second, ["calc.py", "new.py"])
    assert shape(only) == shape(build_index(first.unionByName(second.where("path = 'new.py'"))))
    assert shape(update_files(g, second, ["gone.py"])) == shape(build_index(first.where("path <> 'gone.py'")))
    assert g.edges.where("kind = 'contains'").count() == g.nodes.where("kind <> 'file'").count()
    ids = {r.id for r in g.nodes.collect()}
    assert len(ids) == g.nodes.count()
    assert {r.source_id for r in g.edges.collect()} | {r.target_id for r in g.edges.collect()} <= ids
    publish(g, f"file://{tmp_path}/index")
    updated = update_index(current(spark, f"file://{tmp_path}/index"), second)
    assert shape(updated) == shape(build_index(second))
    kept = {(r.file_path, r["name"]): r.id for r in g.nodes.where("file_path = 'calc.py'").collect()}
    assert {(r.file_path, r["name"]): r.id for r in updated.nodes.where("file_path = 'calc.py'").collect()} == kept
    assert {"weigh", "beside"} <= {r["name"] for r in unused_symbols(updated).collect()}
    publish(updated, f"file://{tmp_path}/index")
    assert shape(current(spark, f"file://{tmp_path}/index")) == shape(updated)


def test_scan_watch_and_history(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "node_modules").mkdir(parents=True)
    for name, text in {"main.rs": RUST, "app.zig": "x", "C.php": "x", "README.md": "x", "data.json": "{}", "node_modules/x.js": "x", "bad.py": ""}.items():
        (root / name).write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    listed = scan_tree(spark, str(root), git_ignore=False)
    assert {r.path: r.content is None for r in listed.where(indexed(F.col("path"))).collect()} == {"main.rs": False, "bad.py": True}
    assert {r.ext: r["count"] for r in unsupported_types(listed).collect()} == {"php": 1, "zig": 1}
    w = Watcher(spark, str(root), f"file://{tmp_path}/watched")
    assert (w.refresh(), w.refresh()) == (True, False)
    (root / "more.py").write_text("def more():\n    beside()\n")
    assert w.refresh()
    assert [r["name"] for r in callers(current(spark, w.folder), "beside").collect()] == ["more"]

    def run(*a):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", "-C", str(root), *a], check=True, capture_output=True)

    run("init", "-q")
    (root / ".gitignore").write_text("*.php\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "more.py").write_text("def more():\n    beside()\n    again()\n")
    assert [tuple(r) for r in git.changed_regions(spark, str(root)).collect()] == [("more.py", 3, 3)]
    assert {r.path: r.commits for r in git.file_churn(spark, str(root)).collect()}["main.rs"] == 1
    assert "a" in git.blame(str(root), "main.rs", 1, 1)
    assert "C.php" not in {r.path for r in scan_tree(spark, str(root)).collect()}


def test_stream_of_files(spark, tmp_path):
    files(spark, a_dot_py="def a():\n    b()\n").write.parquet(f"{tmp_path}/in/1")
    files(spark, b_dot_py="def b():\n    pass\n").write.parquet(f"{tmp_path}/in/2")
    schema = files(spark, x_dot_py="").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_index(source, f"file://{tmp_path}/index", f"file://{tmp_path}/progress")
    q.processAllAvailable()
    q.stop()
    assert [r["name"] for r in callers(current(spark, f"file://{tmp_path}/index"), "b").collect()] == ["a"]


def test_checks_of_paths_and_refs(tmp_path):
    (tmp_path / "link").symlink_to("/etc")
    for bad in ("/etc/passwd", "../x", "a/../../x", "", "C:\\x"):
        with pytest.raises(ValueError, match="path"):
            relative_path(bad)
    with pytest.raises(ValueError, match="leaves"):
        safe_join(str(tmp_path), "link/passwd")
    assert safe_join(str(tmp_path), "a/b.rs").name == "b.rs"
    for bad in ("-x", "", "a b", "a;b"):
        with pytest.raises(ValueError, match="revision"):
            git.checked_ref(bad)
    assert git.checked_ref("HEAD~1") == "HEAD~1"


def test_catalogue_of_an_index(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "main.rs").write_text(RUST)
    (tmp_path / "tree" / "calc.py").write_text(PYTHON)
    c = CodeIndex.build(spark, str(tmp_path / "tree"))
    assert [r["name"] for r in c.callers("weigh").collect()] == ["load"]
    assert c.definition("weigh", 1).first().text == "\nfn weigh(books: &[Book]) -> u32 { books.len() as u32 } fn beside() { restock() }\n"
    assert {r["name"] for r in c.file("calc.py").collect()} == {"calc.py", "moon", "tide", "wave", "Buoy", "report"}
    assert [r["name"] for r in c.search("re").collect()] == ["report", "restock"]
    assert {r["name"] for r in c.impact("tide").collect()} == {"report", "Buoy"}
    assert c.hierarchy("Buoy").count() == 2
    assert c.module_graph()["cycles"].count() == 0
    assert {r["name"]: r["count"] for r in c.status().where("section = 'total'").collect()}["files"] == 2
    assert as_markdown(c.callers("nobody")) == "No results."
    assert as_markdown(c.node("weigh").select("name", "kind")) == "| name | kind |\n| --- | --- |\n| weigh | function |"
    assert '"docstring":null' in as_json(c.node("weigh")).first().value
    (tmp_path / "tree" / "calc.py").write_text(PYTHON + "\n\ndef extra():\n    beside()\n")
    again = c.reindex(["calc.py"])
    assert [r["name"] for r in again.callers("beside").collect()] == ["extra"]
    assert {r["name"]: r["count"] for r in again.counters().collect()} | {"nodes": 0, "edges": 0, "resolved_refs": 0} == {"files": 2, "skipped": 1, "errors": 0, "nodes": 0, "edges": 0, "resolved_refs": 0}
    with pytest.raises(ValueError, match="path"):
        c.reindex(["../x"])
    folder = f"file://{tmp_path}/index"
    assert published(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        current(spark, folder)
    for _ in range(3):
        publish(c.graph, folder)
    assert prune(spark, folder, keep=1) == 2
    before = shape(current(spark, folder))
    stored = current(spark, folder)
    for q in ("height", "buoy report", "weigh", "nothing", ""):
        assert semantic_search(stored, q).collect() == semantic_search(c.graph, q).collect()
    assert [r["name"] for r in semantic_search(stored, "whatever it holds").collect()] == ["restock"]
    compact(spark, folder)
    opened = CodeIndex.open(spark, folder)
    assert shape(opened.graph) == before
    assert opened.status().where("name = 'bytes'").first()["count"] > 1000
