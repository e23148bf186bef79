"""Facts of source files: definitions, imports, calls, base types and routes.

Python files are read with the standard parser; for the brace languages a
scanner blanks comments and strings, so that positions stay, and matches
patterns and braces. Files are independent of each other, so this is one pass
over batches of files, without a shuffle.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import EMITS

#: Files read, and facts passed on, at once.
SLICE, FACTS = 16, 2048
VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "all", "use")
_NOT_CALLS = frozenset("if for while switch catch return function sizeof typeof new await super import require using lock foreach fn func match loop impl else do throw defined alignof static_assert elif".split())
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_CALL = re.compile(r"(?<![\w.:>])([A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*)\s*!?\(")


@dataclass
class Source:
    """A file's text, the same with comments and strings blanked, and where its lines start."""

    text: str
    lang: str
    code: str = ""
    lines: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        rust = self.lang == "rust"  # there ' also starts lifetimes

        def blank(m: re.Match) -> str:
            s = m.group()
            return s if rust and s[0] == "'" and len(s) > 4 else re.sub(r"[^\n]", " ", s)

        self.code = _COMMENT.sub(blank, self.text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.lines, offset) - 1
        return line, offset - self.lines[line]

    def close(self, offset: int) -> int:
        """The place after the brace that closes the first one from offset on; the end of the line if none comes before a semicolon."""
        start = re.compile(r"[{;]").search(self.code, offset)
        if not start or start.group() == ";":
            end = self.code.find("\n", offset)
            return len(self.code) if end < 0 else end
        depth = 0
        for m in re.compile(r"[{}]").finditer(self.code, start.start()):
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return m.end()
        return len(self.code)

    def doc(self, offset: int) -> str | None:
        """The comment that ends right before a definition."""
        above = self.text[:offset].rstrip()
        m = re.search(r"(/\*(?:(?!\*/).)*\*/|(?://[^\n]*\n?\s*)+)$", above, re.DOTALL)
        return re.sub(r"(?m)^\s*(?:/\*+|\*+/|\*|///?)\s?|\s*\*/$", "", m.group(1)).strip() or None if m else None


@dataclass(frozen=True)
class Rules:
    """Patterns of a brace language. Definitions: (label, pattern with group name)."""

    defines: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    bases: tuple[str, ...] = ()
    routes: str | None = None


_PARAMS = r"\((?:[^;{}()]|\([^()]*\))*\)"
_C_BODY = rf"(?P<name>~?[A-Za-z_]\w*)\s*{_PARAMS}\s*(?:(?:const\b|noexcept\b|override\b|final\b|throws\s+[\w.,\s]+|where\s[^{{;]+|->\s*[\w:<>&*\s]+|:\s*[^{{;]+)\s*)*\{{"
_C_FUNCTION = rf"(?m)(?<=[\w>*&\]\s]){_C_BODY}"
_JS = Rules(
    defines=(
        ("Function", r"\bfunction\s*\*?\s*(?P<name>\w+)\s*[(<]"),
        ("Class", r"\bclass\s+(?P<name>[A-Za-z_]\w*)"),
        ("Function", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=;{]+)?=>|\w+\s*=>)"),
        ("Method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+|\*\s*)*(?P<name>[A-Za-z_]\w*)\s*(?:<[^>]*>)?{_PARAMS}\s*(?::\s*[^;{{}}=]+)?\{{"),
    ),
    imports=(r"(?m)^\s*(?:import|export)\b[^'\";]*?from\s*['\"]([^'\"]+)['\"]", r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    bases=(r"\bclass\s+(?P<name>\w+)(?:<[^>]*>)?\s+extends\s+(?P<bases>[\w.]+)", r"\binterface\s+(?P<name>\w+)(?:<[^>]*>)?\s+extends\s+(?P<bases>[\w., ]+)"),
    routes=rf"\b[\w.]+\.(?P<verb>{'|'.join(VERBS)})\(\s*['\"`](?P<path>[^'\"`]*)['\"`]\s*,\s*(?P<handler>[A-Za-z_][\w.]*(?=\s*[,)]))?",
)
_TS = Rules((*_JS.defines, ("Interface", r"\binterface\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Type", r"(?m)^\s*(?:export\s+)?type\s+(?P<name>\w+)[^=;\n]*=")), _JS.imports, _JS.bases, _JS.routes)
_JAVA_TYPES = (("Class", r"\b(?:class|record)\s+(?P<name>[A-Za-z_]\w*)"), ("Interface", r"\binterface\s+(?P<name>[A-Za-z_]\w*)"), ("Enum", r"\benum\s+(?P<name>[A-Za-z_]\w*)"))
_BODILESS = ("Method", r"(?m)^[ \t]*(?:(?:public|protected|private|abstract|static|default)\s+)*(?!return\b|throw\b|new\b|else\b)[\w<>\[\].]+\s+(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*\)\s*;")
RULES: dict[str, Rules] = {
    "javascript": _JS,
    "typescript": _TS,
    "java": Rules((*_JAVA_TYPES, ("Method", _C_FUNCTION), _BODILESS), (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",), (r"\bclass\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[\w.]+))?(?:\s+implements\s+(?P<more>[\w., ]+))?",)),
    "csharp": Rules(
        (("Module", r"\bnamespace\s+(?P<name>[\w.]+)"), *_JAVA_TYPES, ("Method", _C_FUNCTION), _BODILESS),
        (r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;",),
        (r"\b(?:class|interface|struct|record)\s+(?P<name>\w+)(?:<[^>]*>)?\s*:\s*(?P<bases>[\w., <>]+)",),
    ),
    "c": Rules(
        (("Class", r"\bstruct\s+(?P<name>[A-Za-z_]\w*)\s*\{"), ("Enum", r"\benum\s+(?P<name>[A-Za-z_]\w*)\s*\{"), ("Type", r"\btypedef\b[^;{]*?\b(?P<name>[A-Za-z_]\w*)\s*;"), ("Function", _C_FUNCTION), ("Function", r"(?m)^[ \t]*#\s*define\s+(?P<name>\w+)\(")),
        (r"(?m)^\s*#\s*include\s*([<\"][^>\"]+[>\"])",),
    ),
    "cpp": Rules(
        (("Class", r"(?<!enum )\b(?:class|struct)\s+(?P<name>[A-Za-z_]\w*)\s*(?:final\s*)?(?::[^;{]*)?\{"), ("Enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>[A-Za-z_]\w*)\s*(?::[^;{]*)?\{"), ("Function", _C_FUNCTION)),
        (r"(?m)^\s*#\s*include\s*([<\"][^>\"]+[>\"])",),
        (r"\b(?:class|struct)\s+(?P<name>\w+)\s*:\s*(?P<bases>[\w:<>, ]+)\{",),
    ),
    "go": Rules(
        (("Function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[(\[]"), ("Interface", r"\btype\s+(?P<name>\w+)\s+interface\b"), ("Class", r"\btype\s+(?P<name>\w+)\s+struct\b"), ("Type", r"(?m)^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\S")),
        (r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", r"(?m)^\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$"),
        (),
        r"\b\w+\.(?P<verb>HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch)\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<handler>[A-Za-z_][\w.]*(?=\s*[,)]))?",
    ),
    "rust": Rules(
        (("Function", r"\bfn\s+(?P<name>\w+)\s*[(<]"), ("Class", r"\bstruct\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Interface", r"\btrait\s+(?P<name>\w+)"), ("Class", r"(?m)^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)"), ("Module", r"\bmod\s+(?P<name>\w+)\s*\{")),
        (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+(?:::\*)?)",),
        (r"(?m)^\s*impl(?:<[^>]*>)?\s+(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<name>\w+)",),
    ),
}
_CONTAINERS = frozenset({"Class", "Interface", "Enum"})


def module_spec(lang: str, path: str, text: str) -> str:
    """The dotted name of a file's module."""
    stem = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
    if lang == "python":
        return stem.removesuffix(".__init__")
    if lang == "go":
        package = re.search(r"(?m)^package\s+(\w+)", text)
        folder = path.rpartition("/")[0].replace("/", ".")
        return ".".join(x for x in (folder, package[1] if package else "") if x) or stem
    return f"{lang}.{stem}"


def _python(text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            left = dotted(n.value)
            return f"{left}.{n.attr}" if left else n.attr
        return None

    def place(n: ast.AST) -> dict:
        return {"sl": n.lineno - 1, "sc": n.col_offset, "el": (n.end_lineno or n.lineno) - 1, "ec": n.end_col_offset or 0}

    stack: list[tuple[ast.AST, tuple[str, ...], bool]] = [(tree, (), False)]
    while stack:
        node, scope, in_class = stack.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            signature = f"class {node.name}" if is_class else f"def {node.name}({ast.unparse(node.args)})"
            yield {"kind": "define", "name": node.name, "label": "Class" if is_class else "Method" if in_class else "Function", "target_name": ".".join((*scope, node.name)), "signature": signature, "doc": ast.get_docstring(node), **place(node)}
            for base in node.bases if is_class else ():
                if b := dotted(base):
                    yield {"kind": "inherit", "name": node.name, "base": b, **place(node)}
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    verbs = [d.func.attr] if d.func.attr in VERBS else []
                    if d.func.attr == "route":
                        listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                        verbs = [e.value for e in getattr(listed, "elts", []) if isinstance(e, ast.Constant)] or ["GET"]
                    for v in verbs:
                        yield {"kind": "route", "method": str(v).upper(), "path_route": d.args[0].value, "handler": node.name, **place(d)}
            scope, in_class = (*scope, node.name), is_class
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield {"kind": "import", "source": a.name, "name": a.asname or a.name.split(".")[0], **place(node)}
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield {"kind": "import", "source": "." * node.level + (node.module or ""), "name": a.asname or a.name, **place(node)}
        elif isinstance(node, ast.Call) and (target := dotted(node.func)):
            yield {"kind": "call", "target_name": target, **place(node)}
        stack += [(c, scope, in_class if isinstance(node, ast.ClassDef) else False) for c in ast.iter_child_nodes(node)]


def _braces(text: str, lang: str) -> Iterator[dict]:
    rules, src = RULES[lang], Source(text, lang)

    def place(a: int, b: int) -> dict:
        (sl, sc), (el, ec) = src.at(a), src.at(b)
        return {"sl": sl, "sc": sc, "el": el, "ec": ec}

    spans: dict[int, tuple[int, int, str, str]] = {}  # by the place of the name: start, end, label, name
    for label, pattern in rules.defines:
        for m in re.finditer(pattern, src.code):
            name, at = m["name"], m.start("name")
            if name in _NOT_CALLS or at in spans or label == "Method" and re.search(r"\b(?:new|return|else|throw)\s*$", src.code[max(0, at - 12) : at]):
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if label in ("Method", "Function") and start == at:
                start = src.code.rfind("\n", 0, at) + 1
                start += len(src.code[start:at]) - len(src.code[start:at].lstrip())
            spans[at] = (start, max(src.close(m.end() - 1 if m.group().endswith(("{", ";")) else m.end()), m.end()), label, name)
    order = sorted(spans)
    found: list[tuple[int, int, str, str, str]] = []
    open_: list[tuple[int, str, str]] = []  # end, label, name
    for at in order:
        start, end, label, name = spans[at]
        while open_ and open_[-1][0] <= at:
            open_.pop()
        in_type = bool(open_) and open_[-1][1] in _CONTAINERS
        if label in ("Function", "Method"):
            if lang in ("javascript", "typescript") and label == "Method" and not in_type:
                continue
            label = "Method" if in_type or lang == "go" and re.match(r"func\s+\(", src.code[start:at]) else "Function"
        local = ".".join([*(n for _, k, n in open_ if k != "Module"), name])
        found.append((at, end, label, name, local))
        signature = " ".join(src.text[start : src.code.find("{", at) if 0 <= src.code.find("{", at) < end else end].split())
        yield {"kind": "define", "name": name, "label": label, "target_name": local, "signature": signature, "doc": src.doc(start), **place(start, end)}
        open_.append((end, label, name))
    for pattern in rules.imports:
        for m in re.finditer(pattern, text):
            if src.code[m.start() + len(m.group()) - len(m.group().lstrip())].isspace() and lang != "go":
                continue  # within a comment or string
            yield {"kind": "import", "source": m[1].strip('"<>'), "name": re.split(r"[./:]+", m[1].strip('"<>*').rstrip("./:"))[-1], **place(m.start(1), m.end(1))}
    for pattern in rules.bases:
        for m in re.finditer(pattern, src.code):
            groups = m.groupdict()
            for base in ",".join(filter(None, (groups.get("bases"), groups.get("more")))).split(","):
                if base := re.sub(r"\b(?:public|private|protected|virtual)\s+|<.*", "", base).strip():
                    yield {"kind": "inherit", "name": m["name"], "base": base, **place(m.start(), m.end())}
    if rules.routes:
        for m in re.finditer(rules.routes, text):
            if not src.code[m.start()].isspace():
                verb = m["verb"].upper()
                yield {"kind": "route", "method": "GET" if verb.startswith("HANDLE") else verb, "path_route": m["path"], "handler": m["handler"], **place(m.start(), m.end())}
    names_at = set(order)
    for m in _CALL.finditer(src.code):
        target = re.sub(r"::|->", ".", m[1])
        if m.start(1) in names_at or target.split(".")[-1] in _NOT_CALLS or target in _NOT_CALLS:
            continue
        yield {"kind": "call", "target_name": target, **place(m.start(1), m.end())}


#: Further languages: a function from (text, lang) to facts.
PLUGINS: dict[str, Callable[[str, str], Iterator[dict]]] = {}
_ARROW = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (x.split() for x in EMITS.split(", "))])


def register(lang: str, extractor: Callable[[str, str], Iterator[dict]]) -> None:
    PLUGINS[lang] = extractor


def facts(lang: str, path: str, text: str | None) -> list[dict]:
    """The facts of a file in order; repeated routes count once. A file of an unknown language has none."""
    text = text or ""
    if lang in PLUGINS:
        found = list(PLUGINS[lang](text, lang))
    elif lang == "python":
        found = list(_python(text))
    elif lang in RULES:
        found = list(_braces(text, lang))
    else:
        return []
    found.sort(key=lambda e: (e["sl"], e["sc"], e["kind"]))
    spec, out, routes = module_spec(lang, path, text), [], set()
    for e in found:
        if e["kind"] == "route":
            key = e["method"], e["path_route"], e.get("handler")
            if key in routes:
                continue
            routes.add(key)
        out.append(e | {"module_spec": spec, "ord": len(out)})
    return out


def extract(files: DataFrame) -> DataFrame:
    """schema.EMITS of files (project, path, lang, content). A worker holds the facts of SLICE files, however many an Arrow batch has."""
    plugins = dict(PLUGINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PLUGINS.update(plugins)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows = [{"project": f["project"], "path": f["path"], "lang": f["lang"]} | e for f in batch.to_pylist() for e in facts(f["lang"], f["path"], f["content"])]
            for at in range(0, len(rows), FACTS):
                yield pa.RecordBatch.from_pylist(rows[at : at + FACTS], schema=_ARROW)

    return files.select("project", "path", "lang", "content").mapInArrow(run, EMITS)
