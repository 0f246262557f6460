"""Symbols and imports of Python source, by the standard parser, one file at a time."""

from __future__ import annotations

import ast
import re
from itertools import accumulate

from ..errors import ParseError, UnsupportedLanguageError
from .facts import FACTS, facts_of, names_used

SYMBOLS = "array<struct<name:string,qualified_name:string,kind:string,parent:string,start_line:int,end_line:int,start_column:int,end_column:int,start_byte:bigint,end_byte:bigint>>"
IMPORTS = "array<struct<target_module:string,is_relative:boolean,alias:string>>"
PARSED = f"file string, symbols {SYMBOLS}, imports {IMPORTS}, parse_errors array<string>, facts {FACTS}, names array<string>"

#: What the parser raises: broken source, bytes that aren't text, and nesting beyond its stack.
UNPARSABLE = (SyntaxError, ValueError, MemoryError, RecursionError)


def module_name(path: str | None) -> str | None:
    """The dotted name of a file; null stays null."""
    if path is None:
        return None
    parts = re.sub(r"\.[^./]+$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def symbols_of(tree: ast.Module, path: str, source: bytes) -> list[tuple]:
    """The module, then its functions, classes and methods in order of the text; lines and columns from 0, columns in bytes.

    The nodes are kept on a stack of this function's own, so no nesting that the parser takes is too deep.
    """
    module, lines = module_name(path), source.split(b"\n")
    at = [0, *accumulate(len(x) + 1 for x in lines)]
    out: list[tuple] = [(module.rpartition(".")[2], module, "module", None, 0, len(lines) - 1, 0, len(lines[-1]), 0, len(source))]
    todo = [(n, module, False) for n in reversed(tree.body)]
    while todo:
        n, parent, in_class = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            own = n.name if parent == module else f"{parent}.{n.name}"
            kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
            first, last = n.lineno - 1, n.end_lineno - 1
            out.append((n.name, own, kind, parent, first, last, n.col_offset, n.end_col_offset, at[min(first, len(at) - 1)] + n.col_offset, at[min(last, len(at) - 1)] + n.end_col_offset))
            todo += [(c, own, kind == "class") for c in reversed(n.body)]
        elif not in_class:  # statements in a class body aren't entered
            todo += [(c, parent, False) for c in reversed(list(ast.iter_child_nodes(n)))]
    return out


def imports_of(tree: ast.Module) -> list[tuple]:
    out: list[tuple] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(a.name, False, a.asname) for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module != "__future__":
            base = "." * n.level + (n.module or "")
            got = [(base if a.name == "*" else base + ("" if not base or base.endswith(".") else ".") + a.name, n.level > 0, a.asname) for a in n.names]
            out += list(dict.fromkeys(got))
    return out


def problem_of(error: BaseException) -> str:
    """line:column: message; the line is 0 where the parser gives none."""
    return f"{getattr(error, 'lineno', None) or 0}:{getattr(error, 'offset', None) or 0}: {error.args[0] if error.args else type(error).__name__}"


def tree_of(source: bytes) -> tuple[ast.Module, list[str]]:
    """The syntax tree, and the errors.  Of source that doesn't parse, the tree holds the top-level pieces that do.

    A piece begins at a line that isn't indented and closes nothing, so a break inside one costs that piece alone.
    """
    try:
        return ast.parse(source), []
    except UNPARSABLE as e:
        errors = [problem_of(e)]
    lines = source.split(b"\n")
    starts = [k for k, x in enumerate(lines) if x[:1].strip() and not x.startswith((b")", b"]", b"}", b"#", b"else", b"elif", b"except", b"finally"))]
    # a decorator belongs to what follows it
    starts = [k for n, k in enumerate(starts) if not n or not lines[starts[n - 1]].startswith(b"@")]
    body: list[ast.stmt] = []
    for first, end in zip(starts, [*starts[1:], len(lines)]):
        try:
            piece = ast.parse(b"\n".join(lines[first:end]))
        except UNPARSABLE:
            continue
        body += ast.increment_lineno(piece, first).body
    return ast.Module(body, []), errors


def parse(path: str, source: bytes | None) -> tuple:
    """(file, symbols, imports, errors, facts, names used); never raises, and a broken file still gives what can be read."""
    source = source or b""
    try:
        tree, errors = tree_of(source)
        return path, symbols_of(tree, path, source), imports_of(tree), errors, facts_of(tree), sorted(names_used(tree))
    except UNPARSABLE as e:
        return path, [], [], [problem_of(e)], [], []


def parse_strictly(path: str, source: bytes | None) -> tuple:
    """What `parse` gives; a file with an error is a ParseError."""
    found = parse(path, source)
    if found[3]:
        raise ParseError(f"{path}: {found[3][0]}")
    return found


#: Parsers by language; each takes (path, source) and gives what `parse` gives.
PARSERS = {"python": parse}


def register_parser(language: str, parser) -> None:  # noqa: ANN001
    """Another language's parser, or another one in the place of one that is there."""
    PARSERS[language] = parser


def parser_for(language: str):  # noqa: ANN201
    if language not in PARSERS:
        raise UnsupportedLanguageError(f"no parser for {language}")
    return PARSERS[language]
