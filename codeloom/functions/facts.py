"""Facts about Python source that rules look for, and the names it uses; from the same syntax tree as the symbols."""

from __future__ import annotations

import ast
import math
import re
from collections import Counter

FACTS = "array<struct<rule:string,line:int,name:string>>"
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
#: Methods that fetch rows in object-relational mappers, words of secrets' names, and the least entropy of a secret.
FETCHES = {"all", "get", "filter", "first", "one", "execute", "query", "select", "fetchone", "fetchall", "scalar"}
QUERY_ROOTS = {"objects", "session", "db", "query", "cursor", "connection", "conn"}
SECRET_WORDS = ("secret", "token", "password", "passwd", "api_key", "apikey", "private_key", "access_key")
LEAST_ENTROPY, SHORTEST_SECRET = 3.0, 16
#: Hexadecimal digits have 4 bits at most: of 32 random ones, as in a digest, 1.1 in 10,000 have under 3.0 and 7 in 10^15 under 2.0.
HEXADECIMAL, LEAST_HEXADECIMAL_ENTROPY = re.compile("[0-9A-Fa-f]+"), 2.0


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def looks_secret(text: str) -> bool:
    """Whether text is long and varied enough, for the characters it is made of, to be a key, token or password."""
    least = LEAST_HEXADECIMAL_ENTROPY if HEXADECIMAL.fullmatch(text) else LEAST_ENTROPY
    return len(text) >= SHORTEST_SECRET and " " not in text and entropy(text) >= least


def dotted(node: ast.AST) -> list[str]:
    """The names of an attribute chain, calls in it passed over."""
    names: list[str] = []
    while isinstance(node, (ast.Attribute, ast.Call)):
        if isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        else:
            node = node.func
    return [node.id, *names[::-1]] if isinstance(node, ast.Name) else names[::-1]


def within(node: ast.AST) -> list[ast.AST]:
    """Nodes below node, functions and classes of their own left out."""
    out, todo = [], list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        out.append(n)
        if not isinstance(n, SCOPES):
            todo += ast.iter_child_nodes(n)
    return out


def names_used(tree: ast.Module) -> set[str]:
    """Names read, attributes, and the strings of __all__."""
    out = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Load, ast.Del))}
    out |= {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    out |= {a.name for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names}
    for n in tree.body:
        if isinstance(n, (ast.Assign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in getattr(n, "targets", [getattr(n, "target", None)])):
            out |= {c.value for c in ast.walk(n.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)}
    return out


def facts_of(tree: ast.Module) -> list[tuple]:
    """(rule, line from 0, name) of all that the rules below find, in order of lines."""
    out: list[tuple] = []
    read = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    exported = {c.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) for c in ast.walk(n.value) if isinstance(c, ast.Constant)}

    def add(rule: str, node: ast.AST, name: str) -> None:
        out.append((rule, node.lineno - 1, name))

    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)) and getattr(n, "module", None) != "__future__":
            for a in n.names:
                bound = a.asname or a.name.partition(".")[0]
                if a.name != "*" and a.asname != a.name and bound not in read and bound not in exported:
                    add("unused_imports", n, bound)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            for default in [*n.args.defaults, *n.args.kw_defaults]:
                made = isinstance(default, ast.Call) and dotted(default.func)[-1:] and dotted(default.func)[-1] in ("list", "dict", "set", "defaultdict")
                if made or isinstance(default, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)):
                    add("mutable_default_args", default, getattr(n, "name", "<lambda>"))
        elif isinstance(n, ast.ExceptHandler):
            caught = n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]
            broad = n.type is None or any(dotted(t)[-1:] in (["Exception"], ["BaseException"]) for t in caught)
            if broad and not any(isinstance(x, ast.Raise) for x in within(n)):
                add("broad_except", n, dotted(n.type)[-1] if n.type is not None and dotted(n.type) else "")
        elif isinstance(n, ast.With) and any("lock" in part.lower() for i in n.items for part in dotted(i.context_expr)):
            if any(isinstance(x, ast.Await) for x in within(n)):
                add("async_deadlock", n, ".".join(dotted(n.items[0].context_expr)))
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            calls = [c for part in n.body for c in [part, *within(part)] if isinstance(c, ast.Call)]
            inner = {id(c.func.value) for c in calls if isinstance(c.func, ast.Attribute)}
            for call in (c for c in calls if id(c) not in inner):  # a chain of calls counts once
                chain = dotted(call.func)
                if chain[-1:] and chain[-1] in FETCHES and QUERY_ROOTS & {x.lower() for x in chain[:-1]}:
                    add("n_plus_one_query", call, ".".join(chain))
        elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.keyword)) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            named = [n.arg or ""] if isinstance(n, ast.keyword) else [".".join(dotted(t)) for t in getattr(n, "targets", [getattr(n, "target", None)])]
            if looks_secret(n.value.value):
                for name in named:
                    if any(w in name.lower() for w in SECRET_WORDS):
                        add("hardcoded_secret", n.value, name)
    return sorted(set(out), key=lambda x: (x[1], x[0], x[2]))
