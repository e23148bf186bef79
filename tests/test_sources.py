"""Ignore rules, extraction, resolution, snapshots and streams."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import resolve
from weftgraph.sources import extract, files, snapshot
from weftgraph.streaming import incremental

PY = '''import os
from flask import Flask as App

class Base:
    """A base."""
    def greet(self, name): return helper(name)

class Service(Base):
    def run(self):
        def inner(): pass
        self.greet("x")
        os.getcwd()

def helper(x):
    return x

@app.route("/health", methods=["GET", "POST"])
def health():
    return helper(1)
'''
TS = '''import { util } from "./util";
// function commented() {}
interface Shape extends Base { area(): number }
enum Color { Red }
type Alias = string;
abstract class Animal { constructor(x: string) { log("class Fake {"); } speak(): void { util(); } }
export class Dog extends Animal { async fetch() { this.speak(); } }
function main() { const d = new Dog(); helper(d); }
const helper = (x) => { main(); };
app.get("/ping", main);
app.post('/users', (req, res) => res.end());
"s".replace("a", b);
'''
JAVA = '''package p;
import java.util.List;
public class Dog extends Animal implements Runnable, Closeable {
    public Dog(String n) { super(n); }
    @Override public void speak() { if (true) { bark(); } }
    private static int bark() { return 1; }
}
interface Speakable { void speak(); }
enum Color { RED }
'''
GO = '''package main

import (
	"fmt"
	"strings"
)

type Animal interface { Speak() string }
type Dog struct { name string }

func (d *Dog) Speak() string { return strings.ToUpper(d.name) }
func main() { http.HandleFunc("/x", hello); fmt.Println(NewDog()) }
func NewDog() *Dog { return nil }
'''
RUST = '''use std::fmt;
mod utils { pub fn helper<'a>(x: &'a str) -> &'a str { x } }
struct Dog { n: i32 }
trait Animal { fn speak(&self); }
impl Animal for Dog { fn speak(&self) { println!("x"); utils::helper("y"); } }
enum Color { Red }
fn main() { let d = Dog { n: 1 }; d.speak(); }
'''
CPP = '''#include <iostream>
#include "my.h"
class Animal { public: Animal(int x) {} virtual void speak() const { help(); } };
struct Dog : public Animal { };
enum class Color { Red };
static int help(int a) { return std::max(a, 1); }
int main() { help(2); return 0; }
'''
CS = '''using System;
namespace MyApp {
    class Dog : Animal, ISpeak {
        public Dog(string n) : base(n) { }
        public void Speak() { Console.WriteLine("x"); Bark(); }
        static void Bark() { }
    }
    interface ISpeak { void Speak(); }
    enum Color { Red }
}
'''


def of(lang, text, kind, *fields, path="src/x"):
    return [tuple(e.get(f) for f in fields) for e in extract.facts(lang, path, text) if e["kind"] == kind]


def labels(lang, text):
    return dict((n, label) for n, label in of(lang, text, "define", "name", "label"))


def test_python():
    assert of("python", PY, "define", "target_name", "label") == [("Base", "Class"), ("Base.greet", "Method"), ("Service", "Class"), ("Service.run", "Method"), ("Service.run.inner", "Function"), ("helper", "Function"), ("health", "Function")]
    assert of("python", PY, "import", "source", "name") == [("os", "os"), ("flask", "App")]
    assert of("python", PY, "inherit", "name", "base") == [("Service", "Base")]
    assert of("python", PY, "route", "method", "path_route", "handler") == [("GET", "/health", "health"), ("POST", "/health", "health")]
    assert {t for (t,) in of("python", PY, "call", "target_name")} >= {"helper", "self.greet", "os.getcwd"}
    assert of("python", PY, "define", "doc")[0] == ("A base.",)
    assert extract.facts("python", "x.py", "def (") == []


def test_typescript():
    assert labels("typescript", TS) == {"Shape": "Interface", "Color": "Enum", "Alias": "Type", "Animal": "Class", "constructor": "Method", "speak": "Method", "Dog": "Class", "fetch": "Method", "main": "Function", "helper": "Function"}
    assert of("typescript", TS, "import", "source") == [("./util",)]
    assert of("typescript", TS, "inherit", "name", "base") == [("Shape", "Base"), ("Dog", "Animal")]
    assert of("typescript", TS, "route", "method", "path_route", "handler") == [("GET", "/ping", "main"), ("POST", "/users", None)]
    assert {"util", "this.speak", "helper", "main"} <= {t for (t,) in of("typescript", TS, "call", "target_name")}


def test_other_languages():
    assert labels("java", JAVA) == {"Dog": "Method", "speak": "Method", "bark": "Method", "Speakable": "Interface", "Color": "Enum"}
    assert ("Dog", "Class") in of("java", JAVA, "define", "name", "label")
    assert of("java", JAVA, "inherit", "base") == [("Animal",), ("Runnable",), ("Closeable",)]
    assert of("java", JAVA, "import", "source") == [("java.util.List",)]
    assert labels("go", GO) == {"Animal": "Interface", "Dog": "Class", "Speak": "Method", "main": "Function", "NewDog": "Function"}
    assert of("go", GO, "import", "source") == [("fmt",), ("strings",)]
    assert of("go", GO, "route", "method", "path_route", "handler") == [("GET", "/x", "hello")]
    assert {n for (n,) in of("rust", RUST, "define", "name")} == {"utils", "helper", "Dog", "Animal", "speak", "Color", "main"}
    assert of("rust", RUST, "inherit", "name", "base") == [("Dog", "Animal")]
    assert of("rust", RUST, "import", "source") == [("std::fmt",)]
    assert {n for (n,) in of("cpp", CPP, "define", "name")} == {"Animal", "speak", "Dog", "Color", "help", "main"}
    assert of("cpp", CPP, "import", "source") == [("iostream",), ("my.h",)]
    assert of("cpp", CPP, "inherit", "name", "base") == [("Dog", "Animal")]
    assert labels("csharp", CS) == {"MyApp": "Module", "Dog": "Method", "Speak": "Method", "Bark": "Method", "ISpeak": "Interface", "Color": "Enum"}
    assert of("csharp", CS, "inherit", "base") == [("Animal",), ("ISpeak",)]
    assert of("csharp", CS, "import", "source") == [("System",)]
    assert of("c", "#include <a.h>\nstruct S { int x; };\nint f(int a) { return g(a); }\n#define M(x) x\n", "define", "name") == [("S",), ("f",), ("M",)]
    assert extract.facts("cobol", "x.cob", "x") == []


def test_module_names():
    assert extract.module_spec("python", "a/b/__init__.py", "") == "a.b"
    assert extract.module_spec("go", "cmd/x.go", "package main\n") == "cmd.main"
    assert extract.module_spec("typescript", "src/a.ts", "") == "typescript.src.a"


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("p", "app.py", "python", PY), ("p", "web.ts", "typescript", TS), ("p", "other.py", "python", "def far(): pass\n\ndef use():\n    helper2()\n    far()\n    a.b()\n    unknown()\n"), ("p", "more.py", "python", "def helper2(): pass\n")]
    return spark.createDataFrame(rows, "project string, path string, lang string, content string")


def test_resolution(sources):
    nodes, edges = resolve.build(sources, extract.extract(sources))
    n = {r.id: r for r in nodes.collect()}
    assert len(n) == nodes.count()
    name = lambda i: n[i].qualified if i is not None else None
    found = {(r.type, name(r.src), name(r.dst), r.confidence) for r in edges.collect()}
    assert ("CALLS", "app.Base.greet", "app.helper", "exact") in found
    assert ("CALLS", "app.Service.run", "app.Base.greet", "exact") in found
    assert ("CALLS", "other.use", "more.helper2", "reference") in found
    assert ("CALLS", "other.use", "other.far", "exact") in found
    assert ("CALLS", "other.use", None, "usage") in found
    assert sum(r.type == "CALLS" and name(r.src) == "other.use" for r in edges.collect()) == 3
    assert ("INHERITS", "app.Service", "app.Base", "exact") in found
    assert ("INHERITS", "typescript.web.Dog", "typescript.web.Animal", "exact") in found
    assert ("HANDLES", "p.web.ts", "typescript.web.GET /ping", "exact") in found
    assert ("CALLS", "typescript.web.GET /ping", "typescript.web.main", "exact") in found
    assert ("IMPORTS", "p.app.py", None, "usage") in found
    assert ("DEFINES", "p.app.py", "app.helper", "exact") in found


def test_identifiers(spark):
    uses = spark.createDataFrame([("p", "a", "any", "myFunc"), ("p", "a", "any", "missing"), ("p", "a", "javascript", "helper"), ("p", "a", "typescript", "console"), ("p", "a", "python", "os"), ("p", "a", "python", "print"), ("p", "a", "java", "List"), ("p", "a", "java", "String"), ("p", "a", "go", "len")], "project string, path string, lang string, name string")
    symbols = spark.createDataFrame([("p", "a", "myFunc", "pkg.old", 0), ("p", "a", "myFunc", "pkg.myFunc", 1)], "project string, path string, name string, qualified string, ord int")
    imports = spark.createDataFrame([("p", "a", "helper", "./helper", 0), ("p", "a", "os", "os", 1), ("p", "a", "List", "java.util.List", 2)], "project string, path string, name string, source string, ord int")
    got = {(r.lang, r.name): (r.kind, r.qualified) for r in resolve.resolve_identifiers(uses, symbols, imports).collect()}
    assert got == {
        ("any", "myFunc"): ("exact", "pkg.myFunc"), ("any", "missing"): ("none", None), ("javascript", "helper"): ("reference", "helper"), ("typescript", "console"): ("reference", "console"),
        ("python", "os"): ("reference", "os"), ("python", "print"): ("reference", "builtins.print"), ("java", "List"): ("exact", "java.util.List"), ("java", "String"): ("reference", "java.lang.String"), ("go", "len"): ("reference", "builtin.len"),
    }


def test_ignore_rules(spark):
    rules = files.parse_rules("# Comment\n*.log\nbuild/\n!important.log\n")
    assert [(r.pattern, r.negated, r.dir_only) for r in rules] == [("*.log", False, False), ("build", False, True), ("important.log", True, False)]
    paths = ["debug.log", "important.log", "src/main.ts", "build/x.ts", "a/build/y.ts", "node_modules/x/a.py", "src/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.where(files.kept_column(F.col("path"), rules)).collect()] == ["important.log", "src/main.ts", "src/b.py"]
    assert files.ignored("build", True, rules) and not files.ignored("build", False, rules)


def test_scan_and_index(spark, tmp_path):
    for path, text in {"src/main.py": "def f(): pass\n", "logs/a.py": "x=1\n", "a.log": "", "README.md": "#", "src/gen.spec.ts": "let x\n", ".gitignore": "*.log\nlogs/\n*.spec.ts\n", "node_modules/x/a.py": "y=1\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.scan(spark, str(tmp_path), "p").collect()
    assert [(r.path, r.lang) for r in found] == [("src/main.py", "python")]


def test_nested_ignore_files(spark, tmp_path):
    """A folder's rules hold below it alone; folders that are never read are not listed."""
    for path in ("a/x.py", "a/gen.py", "b/gen.py", "b/deep/gen.ts", "env/e.py", ".gradle/g.java", "a/.gitignore"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("gen.*\n" if path.endswith("ignore") else "")
    assert files.walk(spark, str(tmp_path)) == ["a/x.py", "b/deep/gen.ts", "b/gen.py", "env/e.py"]
    assert sorted(r.path for r in files.scan(spark, str(tmp_path), "p", ["b/deep/"]).collect()) == ["a/x.py", "b/gen.py", "env/e.py"]
    assert files.scan(spark, str(tmp_path), "p", ["*.py", "*.ts"]).count() == 0


def test_snapshots(spark, tmp_path):
    t = snapshot.empty(spark)
    row = lambda i, name, file, project: (i, project, file, 1, 0, 2, 0, "Function", name, f"{project}.{name}", None, None)
    t["nodes"] = spark.createDataFrame([row(1, "foo", "a.ts", "proj"), row(2, "bar", "b.ts", "proj"), row(3, "x", "x.ts", "other")], t["nodes"].schema)
    t["edges"] = spark.createDataFrame([(1, "proj", 1, 2, "CALLS", "exact", 3, 0)], t["edges"].schema)
    t["projects"] = spark.createDataFrame([("proj", "/p", 2, 1, 0, 0), ("other", "/o", 1, 0, 0, 0)], t["projects"].schema)
    t["files"] = spark.createDataFrame([("proj", "a.ts", "typescript", "h", 0, 0)], t["files"].schema)
    snapshot.export(t, str(tmp_path / "s"), 5, project="proj")
    assert snapshot.header(spark, str(tmp_path / "s")) == {"format": "graph-snapshot", "version": 1, "createdAt": 5, "projects": ["proj"]}
    back = snapshot.load(spark, str(tmp_path / "s"))
    assert (back["nodes"].count(), back["edges"].count()) == (2, 1)
    assert snapshot.import_(t, back)["nodes"].count() == 3
    renamed = snapshot.import_(snapshot.empty(spark), back, project="other-proj", source="proj")
    assert {r.project for r in renamed["nodes"].collect()} == {"other-proj"}
    stale = t | {"files": t["files"].unionByName(spark.createDataFrame([("proj", "stale.ts", "typescript", "h", 0, 0)], t["files"].schema))}
    assert [r.path for r in snapshot.import_(stale, back, mode="replace")["files"].collect()] == ["a.ts"]
    with pytest.raises(ValueError, match="mode"):
        snapshot.import_(t, back, mode="other")


def test_watch(spark, tmp_path):
    schema = "project string, path string, lang string, content string"
    inbox, state = tmp_path / "in", incremental.GraphState(spark, str(tmp_path / "state"))
    put = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(str(inbox))
    run = lambda: incremental.watch(spark.readStream.schema(schema).parquet(str(inbox)), state, str(tmp_path / "cp")).awaitTermination()
    put(("p", "a.js", "javascript", "function greet() { helper(); }\n"))
    run()
    assert {r.name for r in state.read()["nodes"].collect()} == {"a.js", "greet"}
    put(("p", "a.js", "javascript", "function greet() { farewell(); }\nfunction farewell() {}\n"), ("p", "b.js", "javascript", "function helper() {}\n"))
    run()
    now = state.read()
    assert sorted(r.name for r in now["nodes"].collect()) == ["a.js", "b.js", "farewell", "greet", "helper"]
    assert now["edges"].where("type = 'CALLS'").count() == 1
    left = incremental.remove_missing(now, spark.createDataFrame([("p", "a.js")], "project string, path string"))
    assert sorted(r.name for r in left["nodes"].collect()) == ["a.js", "farewell", "greet"]


def test_streamed_trace_counts(spark, tmp_path):
    spark.createDataFrame([(["a", "b", "a", "b"],), (["b", "a"],), (["a"],)], "calls array<string>").write.parquet(str(tmp_path / "t"))
    stream = incremental.trace_counts(spark.readStream.schema("calls array<string>").parquet(str(tmp_path / "t")))
    q = stream.writeStream.format("memory").queryName("trace_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("trace_counts").collect())) == [("a", "b", 2), ("b", "a", 2)]


def test_long_signatures_stay_whole():
    params = ", ".join(f"parameter{i}: number" for i in range(40))
    found = [e["signature"] for e in extract.facts("typescript", "a.ts", f"function long({params}) {{\n}}\n") if e["kind"] == "define"]
    assert found == [f"function long({params})"]


def test_extraction_passes_facts_on_in_pieces(spark, monkeypatch):
    """A worker never holds the facts of a whole Arrow batch, nor makes one batch of them."""
    import pyarrow as pa

    given = []
    df = spark.createDataFrame([("p", "a.py", "python", PY)], "project string, path string, lang string, content string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, out: given.append(run) or self)
    extract.extract(df)
    n = 4 * extract.SLICE
    files_ = pa.RecordBatch.from_pylist([{"project": "p", "path": f"a{i}.py", "lang": "python", "content": PY} for i in range(n - 1)] + [{"project": "p", "path": "long.py", "lang": "python", "content": "f()\n" * 3 * extract.FACTS}])
    read = []
    monkeypatch.setattr(extract, "facts", lambda *a, f=extract.facts: read.append(a[1]) or f(*a))
    made = given[0](iter([files_]))
    assert 0 < next(made).num_rows <= extract.FACTS and len(read) <= extract.SLICE
    sizes = [b.num_rows for b in made]
    assert max(sizes) <= extract.FACTS and len(read) == n and sum(sizes) > 3 * extract.FACTS


def test_graph_is_built_without_the_driver(spark, sf_dir):
    """Joins of tables that both grow are merged, however small Spark takes one side for."""
    from weftgraph.plans import catalogue, code_catalogue  # noqa: F401  the latter adds its queries to the former

    for name in ("index_calls", "index_imports", "index_inherits"):
        df = catalogue.QUERIES[name](spark, sf_dir)
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_enclosing_joins_only_spans_around_a_point(spark):
    """Spans of the same lines that are not around a point are no rows; of nested ones the innermost counts."""
    spans = spark.createDataFrame([("p", i, 0, i, 9, i) for i in range(60)] + [("p", 0, 0, 200, 0, 99)], "path string, sl int, sc int, el int, ec int, id long")
    points = spark.createDataFrame([("p", 5, 3, "x"), ("p", 5, 9, "y"), ("p", 190, 0, "z"), ("q", 5, 3, None)], "path string, sl int, sc int, name string")
    df = resolve.enclosing(points, spans, ["path"])
    assert {(r.path, r.name): r.inside for r in df.collect()} == {("p", "x"): 5, ("p", "y"): 99, ("p", "z"): 99, ("q", None): None}
    join = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "_start" in join and "_end" in join
