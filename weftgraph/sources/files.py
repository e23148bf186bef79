"""Source trees: scan, ignore rules, languages, hashes."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never read, the names of ignore files, and suffixes.
IGNORED_DIRS = (
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "target", "out", "venv", ".venv", "__pycache__", ".next", ".nuxt", ".cache", "bin", "obj", ".gradle", ".idea", ".vscode",
    "coverage", ".tox", ".mypy_cache", ".pytest_cache", "vendor", ".terraform",
)
IGNORE_FILES = (".gitignore", ".cbm-ignore")
LANGUAGES = {
    "python": (".py",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", ".es6"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "java": (".java",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "c": (".c", ".h"),
    "csharp": (".cs",),
    "go": (".go",),
    "rust": (".rs",),
}
OF_SUFFIX = {suffix: lang for lang, suffixes in LANGUAGES.items() for suffix in suffixes}


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file; it holds for what lies in the folder `base`, empty for all."""

    pattern: str
    negated: bool
    dir_only: bool
    regex: str
    base: str = ""


def rule_regex(pattern: str) -> str:
    """** matches across folders, * and ? within one; a pattern with a slash starts at the root."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out += ".*"
            i += 2
            continue
        c = pattern[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    anchored = "/" in pattern
    return ("^" if anchored else "(^|/)") + out.removeprefix("/") + "(/.*)?$"


def parse_rules(text: str, base: str = "") -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!")
        dir_only = line.endswith("/")
        line = line.rstrip("/")
        if line:
            rules.append(Rule(line, negated, dir_only, rule_regex(line), base))
    return rules


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """By the last rule that matches."""
    out = False
    for r in rules:
        if (is_dir or not r.dir_only) and (not r.base or path.startswith(r.base + "/")) and re.search(r.regex, path, re.IGNORECASE):
            out = not r.negated
    return out


def ignored_column(path: Column, rules: list[Rule], is_dir: bool = False) -> Column:
    """The same of a column, as one expression."""
    out = F.lit(False)
    for r in rules:
        if is_dir or not r.dir_only:
            hit = path.rlike("(?i)" + r.regex)
            out = F.when(path.startswith(r.base + "/") & hit if r.base else hit, not r.negated).otherwise(out)
    return out


def kept_column(path: Column, rules: list[Rule] = (), ignored_dirs: tuple[str, ...] = IGNORED_DIRS) -> Column:
    """Whether a file is read: no folder above it is ignored, and neither is the file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    above = F.transform(folders, lambda _, i: F.array_join(F.slice(folders, 1, i + 1), "/"))
    hidden = F.exists(above, lambda p: ignored_column(p, list(rules), True))
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in ignored_dirs])) & ~hidden & ~ignored_column(path, list(rules))


def language(path: Column | str) -> Column:
    """The language of the longest known suffix; null for none."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(None).cast("string")
    for suffix in sorted(OF_SUFFIX, key=len):
        out = F.when(F.lower(path).endswith(suffix), OF_SUFFIX[suffix]).otherwise(out)
    return out


def supported(path: Column | str) -> Column:
    return language(path).isNotNull()


def content_hash(content: Column | str) -> Column:
    return F.sha1(content)


def walk(spark: SparkSession, root: str, extra: list[Rule] = ()) -> list[str]:
    """The supported files under root that no rule hides, as paths below it."""
    return [path for path, _, _ in _found(spark, root, extra)]


def _found(spark: SparkSession, root: str, extra: list[Rule]) -> list[tuple[str, int, int]]:
    """The same with size and time of change.

    Spark's readers pass over hidden files, so ignore files are opened through
    the file system that root lies in. Folders that are never read, or that a
    rule hides, are not listed; the rules of a folder hold below it, after those
    of the folders above.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[tuple[str, int, int]] = []
    todo: list[tuple[str, list[Rule]]] = [("", [])]
    while todo:
        folder, rules = todo.pop()
        found = [(s.getPath().getName(), s.isDirectory(), s) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(top, folder) if folder else top)]
        for wanted in IGNORE_FILES:
            for name, is_dir, at in found:
                if name == wanted and not is_dir:
                    stream = fs.open(at.getPath())
                    try:
                        rules = rules + parse_rules(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), folder)
                    finally:
                        stream.close()
        used = [*rules, *extra]
        for name, is_dir, at in found:
            path = f"{folder}/{name}" if folder else name
            if name in IGNORED_DIRS or ignored(path, is_dir, used):
                continue
            if is_dir:
                todo.append((path, rules))
            elif any(name.lower().endswith(x) for x in OF_SUFFIX):
                out.append((path, at.getLen(), at.getModificationTime()))
    return sorted(out)


def scan(spark: SparkSession, root: str, project: str, extra: list[str] | None = None) -> DataFrame:
    """(project, path, lang, content, hash, mtime): the supported files under root that no rule hides; path is relative.

    Only the contents of these files are read. Their names go through the
    driver, as do those of any files that Spark reads.
    """
    root = root.rstrip("/")
    found = _found(spark, root, parse_rules("\n".join(extra or [])))
    # Spark's reader gives no row for an empty file
    out = spark.createDataFrame([(project, p, "", t) for p, n, t in found if not n], "project string, path string, content string, mtime long")
    paths = [f"{root}/{p}" for p, n, _ in found if n]
    if paths:
        out = out.unionByName(_contents(spark, root, project, paths))
    return out.select("project", "path", language("path").alias("lang"), "content", content_hash("content").alias("hash"), "mtime")


def _contents(spark: SparkSession, root: str, project: str, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    tail = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.split("://")[-1]) + "/", "")
    return files.select(F.lit(project).alias("project"), tail.alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").alias("mtime"))


def ledger(files: DataFrame, now: int) -> DataFrame:
    """schema.FILES of scanned files."""
    return files.select("project", "path", "lang", "hash", "mtime", F.lit(now).cast("long").alias("indexed_at"))


def version_control_changes(spark: SparkSession, repo: str, timeout: float = 5.0) -> DataFrame:
    """(file, status): changed, then untracked files; empty where git can't tell."""
    rows: dict[str, str] = {}
    for status, args in (("modified", ("diff", "--name-only", "HEAD")), ("untracked", ("ls-files", "--others", "--exclude-standard"))):
        try:
            done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=timeout, check=True)
        except (OSError, subprocess.SubprocessError):
            continue
        for line in done.stdout.splitlines():
            if line.strip():
                rows.setdefault(line.strip(), status)
    return spark.createDataFrame(list(rows.items()), "file string, status string")
