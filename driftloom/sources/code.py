"""Python source texts as tables: parse status, functions, classes, imports, calls, undefined names, lines.

A frame of (path, text) goes through one Arrow map for each kind of fact; parsing has no built-in form. Rows are independent; they are
dealt evenly first, as parsing costs far more than reading and a small file would be one task. Null texts count as empty. A text that does not parse is repaired (byte-order mark, null characters, tabs), then
loses up to ``DROPS`` lines that the parser names, and is quarantined if it still does not parse, or is larger than ``MOST``
characters: it then has a status row and no facts.
"""

from __future__ import annotations

import ast
import builtins
import fnmatch
import hashlib
import re
import symtable
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 5_000_000
DROPS = 3
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp)


def read(spark: SparkSession, folder: str, suffix: str = "*.py", include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """The files below a folder that match: path, relative, text. Any scheme that Spark's readers know works.

    Hidden folders and caches below the folder are left out, wherever it lies itself. ``include`` keeps what lies in these relative folders (or
    is named so), ``exclude`` drops such, and ``ignore`` are the lines of an ignore file. Spark's readers skip names that begin with a
    dot or an underscore, ``__init__.py`` among them; those are listed apart and read through Arrow's file systems.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = files.makeQualified(where).toUri().getPath().rstrip("/")
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(folder, wholetext=True)
    # the scheme and host may be spelled in other ways, the path is not
    bare = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9+.-]+:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B")))
    named = found.select(F.col("_metadata.file_path").alias("path"), F.substr(bare, F.lit(len(root) + 2)).alias("relative"), F.col("value").alias("text"))
    skipped, listed = [], files.listFiles(where, True)
    while listed.hasNext():
        at = listed.next().getPath()
        relative = at.toUri().getPath()[len(root) + 1 :]
        if fnmatch.fnmatchcase(at.getName(), suffix) and re.search(r"(^|/)[._]", relative):
            skipped.append((at.toString(), relative))
    if skipped:
        apart = spark.createDataFrame(skipped, "path string, relative string")
        named = named.where(~F.col("relative").rlike("(^|/)[._]")).unionByName(apart.mapInArrow(_opened, "path string, relative string, text string"))
    inside = lambda folders: F.exists(F.array(*[F.lit(f.strip("/")) for f in folders]), lambda f: (F.col("relative") == f) | F.col("relative").startswith(F.concat(f, F.lit("/"))))
    kept = ~F.col("relative").rlike(r"(^|/)(\.[^/]+|__pycache__)/")
    if include and "." not in include:
        kept = kept & inside(include)
    if exclude:
        kept = kept & ~inside(exclude)
    return named.where(kept & ~ignored(F.col("relative"), ignore))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        texts = []
        for path in batch.column("path").to_pylist():
            system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
            with system.open_input_stream(at) as stream:
                texts.append(stream.read().decode("utf-8", "replace"))
        yield batch.append_column("text", pa.array(texts, pa.string()))


def _form(body: str) -> str:
    """A pattern's body as a regular expression: ``*``, ``?``, ``[...]`` and ``**``."""
    out, k = "", 0
    while k < len(body):
        end = body.find("]", k + 2)
        if body.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "[" and end > 0:
            inner = body[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, k = out + "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif body[k] == "\\" and k + 1 < len(body):
            out, k = out + re.escape(body[k + 1]), k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(body[k], re.escape(body[k])), k + 1
    return out


def ignored(path: F.Column, patterns: Sequence[str]) -> F.Column:
    """Whether the lines of an ignore file leave a relative path out.

    ``*``, ``?``, ``[...]`` (``[!...]``), ``**``, ``\\`` before a mark, a slash in front or inside for paths from the root, a trailing one for folders and
    ``!`` to take a path in again. The last line that matches the path, or else a folder above it, decides, so what lies in a folder that is left out stays out unless a line takes in
    the folder or the path itself. Empty lines and ``#`` lines count for nothing; null gives null.
    """
    found = F.when(path.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    for line in patterns:
        pattern = line.strip()
        if not pattern or pattern.startswith("#"):
            continue
        take_in, pattern = pattern.startswith("!"), pattern.removeprefix("!")
        body = pattern.strip("/")
        start = "^" if "/" in pattern.rstrip("/") else "(^|.*/)"
        hit = path.rlike(f"{start}{_form(body)}{'/' if pattern.endswith('/') else '(/|$)'}")
        found = F.when(hit, not take_in).otherwise(found)
    return found


def parse(text: str | None) -> tuple[ast.Module | None, str, list[str]]:
    """Syntax tree, status (parsed, repaired, recovered, quarantined) and warnings."""
    text = text or ""
    if len(text) > MOST:
        return None, "quarantined", ["too large"]
    status, said = "parsed", []
    lines = None
    for _ in range(DROPS + 2):
        try:
            return ast.parse(text), status, said
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            if status == "parsed":
                text, status = text.lstrip("﻿").replace("\0", "").expandtabs(4), "repaired"
                continue
            lines, at = text.split("\n"), getattr(error, "lineno", None)
            if not at or at > len(lines) or len(said) >= DROPS:
                break
            said.append(f"line {at} dropped")
            lines[at - 1] = ""
            text, status = "\n".join(lines), "recovered"
    return None, "quarantined", [*said, "does not parse"]


def _body(node: ast.AST) -> list[ast.stmt]:
    body = node.body
    return body[1:] if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str) else body


def body_kind(node: ast.AST) -> str:
    """pass, not_implemented, trivial_return, todo, ellipsis or code: what a function's body is without its docstring."""
    body = _body(node)
    if not body:
        return "todo" if any(w in (ast.get_docstring(node) or "").upper() for w in ("TODO", "FIXME")) else "doc"
    if len(body) > 1:
        return "code"
    only = body[0]
    if isinstance(only, ast.Pass):
        return "pass"
    if isinstance(only, ast.Raise):
        raised = only.exc.func if isinstance(only.exc, ast.Call) else only.exc
        return "not_implemented" if isinstance(raised, ast.Name) and raised.id == "NotImplementedError" else "code"
    if isinstance(only, ast.Return):
        value = only.value
        empty = isinstance(value, (ast.List, ast.Tuple, ast.Set)) and not value.elts or isinstance(value, ast.Dict) and not value.keys
        return "trivial_return" if value is None or isinstance(value, ast.Constant) or empty else "code"
    if isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is ...:
        return "ellipsis"
    return "code"


def _called(node: ast.AST) -> str | None:
    return node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None


def _name(node: ast.AST) -> str:
    return ast.unparse(node.func if isinstance(node, ast.Call) else node)


class _Plain(ast.NodeTransformer):
    """Names and constants give way to marks, so that only the structure is left."""

    def visit_Name(self, node):
        return ast.copy_location(ast.Name("v", node.ctx), node)

    def visit_arg(self, node):
        return ast.copy_location(ast.arg("a"), node)

    def visit_Constant(self, node):
        return ast.copy_location(ast.Constant("c"), node)


@lru_cache(1 << 16)
def _structure(statement: str) -> str:
    """A statement without its names and constants; few forms make up most bodies."""
    return ast.dump(_Plain().visit(ast.parse(statement).body[0]))


def _functions(tree: ast.Module) -> Iterator[tuple]:
    def walk(node: ast.AST, owner: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inside = list(ast.walk(child))
                plain = "\n".join(_structure(ast.unparse(s)) for s in _body(child))
                yield (
                    child.name, owner, child.lineno, child.end_lineno, len(child.args.args) + len(child.args.kwonlyargs), body_kind(child),
                    ast.get_docstring(child) is not None, isinstance(child, ast.AsyncFunctionDef), 1 + sum(isinstance(x, _BRANCHES) for x in inside),
                    [_name(d) for d in child.decorator_list], sorted({c for x in inside if isinstance(x, ast.Call) and (c := _called(x))}),
                    any(isinstance(x, ast.Name) and x.id == "self" for x in inside), hashlib.sha256(plain.encode()).hexdigest()[:16],
                )
            yield from walk(child, child.name if isinstance(child, ast.ClassDef) else owner)

    yield from walk(tree, None)


def _classes(tree: ast.Module) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            methods = [x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            start = next((x for x in methods if x.name == "__init__"), None)
            supers = start is not None and any(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == "super" for x in ast.walk(start))
            fields = sorted({
                t.attr for x in ast.walk(start or ast.Pass()) if isinstance(x, ast.Assign)
                for t in x.targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"
            })
            yield node.name, node.lineno, [_name(b) for b in node.bases], [m.name for m in methods], start is not None, supers, fields


def _imports(tree: ast.Module) -> Iterator[tuple]:
    top = set(map(id, tree.body))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for alias in node.names:
                yield alias.name, [], node.lineno, 0, False, id(node) in top
        elif isinstance(node, ast.ImportFrom):
            names = [a.name for a in node.names]
            yield node.module, names, node.lineno, node.level, names == ["*"], id(node) in top


def _calls(tree: ast.Module) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and (name := _called(node)):
            yield name, node.lineno, len(node.args) + len(node.keywords)


_KNOWN = frozenset(dir(builtins)) | {"__file__", "__name__"}


def _undefined(tree: ast.Module) -> Iterator[tuple]:
    known, seen = _KNOWN, set()
    top = symtable.symtable(ast.unparse(tree), "m", "exec")
    here = {s.get_name() for s in top.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()}
    stack = [top]
    while stack:
        table = stack.pop()
        stack += table.get_children()
        for s in table.get_symbols():
            free = s.is_referenced() and (s.is_global() or table is top) and s.get_name() not in here | known
            if free and s.get_name() not in seen:
                seen.add(s.get_name())
                yield (s.get_name(),)


_KINDS: dict[str, tuple[Callable, str]] = {
    "functions": (_functions, "name string, owner string, line int, end_line int, args int, body string, documented boolean, is_async boolean, "
                  "complexity int, decorators array<string>, calls array<string>, uses_self boolean, structure string"),
    "classes": (_classes, "name string, line int, bases array<string>, methods array<string>, has_init boolean, super_init boolean, fields array<string>"),
    "imports": (_imports, "module string, names array<string>, line int, level int, star boolean, top boolean"),
    "calls": (_calls, "name string, line int, args int"),
    "undefined": (_undefined, "name string"),
}


def _spread(sources: DataFrame, path: str, text: str) -> DataFrame:
    """Paths and texts over all cores, in several rounds of tasks."""
    spark = sources.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return sources.select(F.col(path).alias("path"), F.col(text).alias("text")).repartition(parts)


def facts(sources: DataFrame, kind: str, path: str = "path", text: str = "text") -> DataFrame:
    """The facts of one kind (a key of ``_KINDS``) of all texts, with their path."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    found, columns = _KINDS[kind]
    schema = StructType.fromDDL(f"path string, {columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        for batch in batches:
            rows = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, _, _ = parse(t)
                rows += [(p, *r) for r in (found(tree) if tree is not None else ())]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return _spread(sources, path, text).mapInArrow(run, schema)


def statuses(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Parse status and warnings of each text: path, status, warnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t)[1:] for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([s for s, _ in found], pa.string()), pa.array([w for _, w in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "status", "warnings"])

    return _spread(sources, path, text).mapInArrow(run, "path string, status string, warnings array<string>")


def rates(status: DataFrame) -> DataFrame:
    """One row: files, and the shares parsed at all, parsed in part and quarantined (0 without files)."""
    share = lambda rule: F.round(F.coalesce(F.count_if(rule) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6)
    return status.agg(
        F.count("*").alias("files"), share(F.col("status") != "quarantined").alias("parsed"), share(F.col("status") == "recovered").alias("partial"),
        share(F.col("status") == "quarantined").alias("quarantined"),
    )


def lines(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Each line with its number from 1: path, number, line."""
    return sources.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("number"), "line")


def pattern_hits(sources: DataFrame, patterns: dict[str, str], around: int = 2) -> DataFrame:
    """Lines that match a pattern, with the lines around them: path, pattern, number, line, context."""
    listed = sources.select("path", F.split(F.coalesce("text", F.lit("")), "\n").alias("all"))
    rules = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(r).alias("regex")) for n, r in patterns.items()])
    hits = listed.select("path", "all", F.posexplode("all").alias("at", "line")).select("path", "all", "at", "line", F.explode(rules).alias("rule"))
    context = F.array_join(F.slice("all", F.greatest(F.col("at") + 1 - around, F.lit(1)), F.least(F.col("at"), F.lit(around)) + around + 1), "\n")
    return hits.where("line rlike rule.regex").select("path", "rule.pattern", (F.col("at") + 1).alias("number"), "line", context.alias("context"))
