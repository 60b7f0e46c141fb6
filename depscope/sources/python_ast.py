"""Python source text to a table of syntax nodes: the one step that needs Python.

``parse_files`` has a row for each node. A file's nodes are numbered in the order of its text, and a node holds the
numbers up to its ``last``, so containment is a range. What entities, edges and figures there are is left to
``operators.entities``. A file's root has number 0 and is always there; of a file that doesn't parse it is all, with
parse_error set. One without content reads as empty.
"""

from __future__ import annotations

import ast
import gc
import hashlib
import io
import re
import tokenize
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Constructors that tell a value's type.
TYPE_OF_CALL = {
    "list": "List", "List": "List", "dict": "Dict", "Dict": "Dict", "set": "Set", "Set": "Set", "tuple": "Tuple",
    "Tuple": "Tuple", "str": "str", "int": "int", "float": "float", "bool": "bool",
}
TYPE_OF_NODE = {ast.Dict: "Dict", ast.Set: "Set", ast.Tuple: "Tuple"}

#: Of a node: where it stands (n, parent, last, depth), what it is (kind, and role in its parent), the innermost function
#: and class around it, the name it has and the name it is an attribute of or an import from; its dotted name, annotation,
#: value and the value's type as written; size counts handlers, values, ifs or an import's dots. The four last are the root's.
NODE = (
    "path string, module string, n int, parent int, last int, depth int, kind string, role string, line int, in_function int, "
    "in_class int, name string, of string, alias string, dotted string, annotation string, value string, shows string, "
    "loaded boolean, size int, docstring string, text string, physical_lines int, logical_lines int, parse_error string, "
    "content_md5 string"
)
COLUMNS = frozenset(c.split()[0] for c in NODE.split(", "))
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Fields without nodes, or with nodes that say nothing beyond their parent: contexts and operators.
SILENT = frozenset("ctx op ops id attr kind level module simple conversion is_async asname type_comment".split())


def module_name(path: str) -> str:
    """The dotted name of a path below the project's root; a package is named by its folder."""
    stem = path.replace("\\", "/").removesuffix(".py").strip("/")
    stem = stem.removesuffix("/__init__") if stem != "__init__" else stem
    return stem.replace("/", ".")


def name_of(node: ast.AST) -> str | None:
    """The dotted name that a node ends in; what is called or subscribed goes by its own name."""
    parts: list[str] = []
    while True:
        match node:
            case ast.Attribute():
                parts.append(node.attr)
                node = node.value
            case ast.Call():
                node = node.func
            case ast.Subscript():
                node = node.value
            case ast.Name(id=first):
                return ".".join([first, *reversed(parts)])
            case ast.Constant(value=value):
                return ".".join(filter(None, [str(value), *reversed(parts)]))
            case _:
                return ".".join(reversed(parts)) or None


def value_type(node: ast.AST | None) -> str | None:
    """The type that a literal or a constructor call shows; a list's is that of its first element, too."""
    lists = 0
    while isinstance(node, ast.List):
        lists, node = lists + 1, node.elts[0] if node.elts else None
    match node:
        case ast.Constant(value=None):
            kind = "None"
        case ast.Constant(value=value):
            kind = type(value).__name__ if type(value) in (str, int, float, bool) else None
        case ast.Call(func=ast.Name(id=name)):
            kind = TYPE_OF_CALL.get(name)
        case _:
            kind = TYPE_OF_NODE.get(type(node))
    if lists and kind is None:
        lists, kind = lists - 1, "List"
    return kind and "List[" * lists + kind + "]" * lists


class Lines:
    """A text, cut into lines once when pieces that nodes span are asked for; of the columns, only those ``wanted`` are made."""

    def __init__(self, text: str, wanted: frozenset[str]) -> None:
        self.text, self.wanted = text, wanted

    @cached_property
    def lines(self) -> list[bytes]:
        return [line.encode("utf-8", "surrogatepass") for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", self.text)]

    def piece(self, node: ast.AST) -> str:
        """The source of ``node``; its columns count UTF-8 bytes."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            out = self.lines[first][node.col_offset : node.end_col_offset]
        else:
            inner = self.lines[first + 1 : last]
            out = b"".join([self.lines[first][node.col_offset :], *inner, self.lines[last][: node.end_col_offset]])
        return out.decode("utf-8", "surrogatepass")

    def written(self, node: ast.AST | None, column: str) -> str | None:
        """How an annotation or a value reads; one nested too deeply to be written anew, as it stands."""
        if node is None or column not in self.wanted:
            return None
        if type(node) is ast.Name:  # names and whole numbers read as they are: unparsing costs ten times as much
            return node.id
        if type(node) is ast.Constant and type(node.value) is int:
            return repr(node.value)
        try:
            return ast.unparse(node)
        except RecursionError:
            return self.piece(node)

    def docstring(self, node: ast.AST) -> str | None:
        return ast.get_docstring(node) if "docstring" in self.wanted else None


def _definition(node: ast.AST, row: dict, text: Lines) -> None:
    row["name"], row["docstring"] = node.name, text.docstring(node)


def _function(node: ast.AST, row: dict, text: Lines) -> None:
    _definition(node, row, text)
    row["annotation"] = text.written(node.returns, "annotation")
    if "text" in text.wanted:
        row["text"] = text.piece(node)


def _arg(node: ast.AST, row: dict, text: Lines) -> None:
    row["name"], row["annotation"] = node.arg, text.written(node.annotation, "annotation")


def _name(node: ast.AST, row: dict, text: Lines) -> None:
    row["name"], row["loaded"] = node.id, type(node.ctx) is ast.Load


def _attribute(node: ast.AST, row: dict, text: Lines) -> None:
    row["name"], row["loaded"] = node.attr, type(node.ctx) is ast.Load
    row["of"] = node.value.id if type(node.value) is ast.Name else None


def _call(node: ast.AST, row: dict, text: Lines) -> None:
    row["dotted"] = name_of(node) or None


def _assigned(node: ast.AST, row: dict, text: Lines) -> None:
    if row["in_class"] is not None:
        row["value"], row["shows"] = text.written(node.value, "value"), value_type(node.value)
        row["annotation"] = text.written(getattr(node, "annotation", None), "annotation")


def _returned(node: ast.AST, row: dict, text: Lines) -> None:
    row["shows"] = value_type(node.value)


def _alias(node: ast.AST, row: dict, text: Lines) -> None:
    row["name"], row["alias"] = node.name, node.asname


def _sized(part: str) -> Callable[[ast.AST, dict, Lines], None]:
    def tell(node: ast.AST, row: dict, text: Lines) -> None:
        row["size"] = len(getattr(node, part))

    return tell


#: What a row tells of its own node, by the node's type.
TELL = {
    ast.ClassDef: _definition, ast.FunctionDef: _function, ast.AsyncFunctionDef: _function, ast.arg: _arg, ast.Name: _name,
    ast.Attribute: _attribute, ast.Call: _call, ast.Assign: _assigned, ast.AnnAssign: _assigned, ast.Return: _returned,
    ast.Try: _sized("handlers"), ast.BoolOp: _sized("values"), ast.comprehension: _sized("ifs"), ast.alias: _alias,
}


@cache
def _parts(kind: type) -> tuple[str, ...]:
    """The fields of a type of node that can hold nodes with rows, last first."""
    return tuple(f for f in reversed(kind._fields) if f not in SILENT)


def numbered(tree: ast.Module, text: Lines, file: dict) -> list[dict]:
    """A row for each node below ``tree`` and itself, by number, with the columns of ``file``. No step is taken by recursion,
    so depth doesn't matter."""
    rows: list[dict] = []
    path, module = file["path"], file["module"]
    todo: list[tuple] = [(tree, None, None, None, 0, None, None)]
    while todo:
        node, role, parent, up, depth, function, owner = todo.pop()
        n, kind = len(rows), type(node)
        row = {
            "path": path, "module": module, "n": n, "parent": parent, "last": n, "depth": depth, "kind": kind.__name__, "role": role,
            "line": getattr(node, "lineno", None), "in_function": function, "in_class": owner,
        }
        if role == "bases" or role == "decorator_list":
            row["dotted"] = name_of(node) or None
        if kind in TELL:
            TELL[kind](node, row, text)
        if kind is ast.alias and up is not None:  # an import counts by its statement
            row["line"] = up.lineno
            if isinstance(up, ast.ImportFrom):
                row["of"], row["size"] = up.module or "", up.level
        rows.append(row)
        if kind in FUNCTION:
            function = n
        elif kind is ast.ClassDef:
            owner = n
        for part in _parts(kind):
            value = getattr(node, part, None)
            if isinstance(value, list):
                for child in reversed(value):
                    if isinstance(child, ast.AST):
                        todo.append((child, part, n, node, depth + 1, function, owner))
            elif isinstance(value, ast.AST):
                todo.append((value, part, n, node, depth + 1, function, owner))
    for row in reversed(rows[1:]):
        above = rows[row["parent"]]
        if above["last"] < row["last"]:
            above["last"] = row["last"]
    return rows


def encoding_of(raw: bytes) -> str:
    """As Python reads it: a byte order mark and an encoding declared in the first two lines count."""
    second = raw.find(b"\n", raw.find(b"\n") + 1)
    head = raw if second < 0 else raw[:second]
    if head.isascii() and b"coding" not in head:
        return "utf-8"
    return tokenize.detect_encoding(io.BytesIO(raw).readline)[0]


def parse_source(path: str, content: bytes | str | None, wanted: frozenset[str] = COLUMNS) -> list[dict]:
    """One file's rows; columns that a node has nothing for, or that aren't ``wanted``, are left out."""
    raw = content.encode("utf-8", "surrogatepass") if isinstance(content, str) else content or b""
    text, error = raw.decode("utf-8", "replace"), None
    file = {"path": path, "module": module_name(path)}
    rows = [{**file, "n": 0, "last": 0, "depth": 0, "kind": "Module"}]
    try:
        text = raw.decode(encoding_of(raw))
        tree = ast.parse(text)
        lines = Lines(text, wanted)
        rows = numbered(tree, lines, file)
        rows[0]["docstring"] = lines.docstring(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        error = f"{type(problem).__name__}: {problem}"
    rows[0]["parse_error"] = error
    if "physical_lines" in wanted or "logical_lines" in wanted:
        full = [x for line in text.split("\n") if (x := line.strip())]
        rows[0] |= {"physical_lines": len(full), "logical_lines": sum(not x.startswith("#") for x in full)}
    if "content_md5" in wanted:
        rows[0]["content_md5"] = hashlib.md5(raw).hexdigest()
    return rows


def column_of(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; half of a surrogate pair, which Python allows and UTF-8 doesn't, stands as its escape."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([v and v.encode("utf-8", "backslashreplace").decode() for v in values], kind)


#: So many rows leave a task together, so that a batch of large files needn't be held.
ROWS = 20_000


def parse_files(files: DataFrame, wanted: Iterable[str] = COLUMNS) -> DataFrame:
    """The nodes of ``files`` (path, content), with the columns of NODE, or those that are ``wanted``: others are never made."""
    wanted = frozenset(wanted)
    schema = T.StructType([f for f in T.StructType.fromDDL(NODE) if f.name in wanted])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        shape = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([column_of([r.get(f.name) for r in rows], f.type) for f in shape], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        gc.disable()  # trees and rows hold no circles, and looking for some takes a fifth of the time
        try:
            for batch in batches:
                for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                    rows += parse_source(path, content, wanted)
                    while len(rows) >= ROWS:
                        yield batch_of(rows[:ROWS])
                        rows = rows[ROWS:]
            if rows:
                yield batch_of(rows)
        finally:
            gc.enable()

    return files.select("path", "content").mapInArrow(run, schema)
