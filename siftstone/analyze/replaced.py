"""What a file may give another meaning at run time, as entries that operators/replacement.py joins."""

from __future__ import annotations

import ast
from typing import NamedTuple

from .names import File


class Entry(NamedTuple):
    """kind: any (all modules), own (any name of this file's module), module (any name of owner), attr (name in owner; an empty owner is this file's module)."""

    kind: str
    owner: str
    name: str
    line: int


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _namespace(node: ast.AST, file: File) -> list[str] | None:
    """Owners whose names the object holds as a module or a module's dictionary: "" is the file's own, "*" any; None for other objects."""
    if isinstance(node, ast.Call) and not node.args and not node.keywords and file.dotted(node.func) & {"globals", "vars"}:
        return [""]
    if isinstance(node, ast.Call) and len(node.args) == 1 and file.dotted(node.func) & {"vars"}:
        return _namespace(node.args[0], file)
    if isinstance(node, ast.Attribute) and node.attr in ("__dict__", "__globals__"):
        return _namespace(node.value, file) or ["*"]
    if isinstance(node, ast.Subscript) and "sys.modules" in file.dotted(node.value):
        name = _text(node.slice)
        return ["" if isinstance(node.slice, ast.Name) and node.slice.id == "__name__" else name if name is not None else "*"]
    if isinstance(node, ast.Call) and file.dotted(node.func) & {"importlib.import_module", "__import__"}:
        name = _text(node.args[0]) if node.args else None
        return [name if name is not None else "*"]
    return sorted(file.dotted(node)) or None


def entries(file: File) -> list[Entry]:
    """Sorted, each with its first line."""
    first: dict[tuple[str, str, str], int] = {}

    def add(owner: str, name: str | None, node: ast.AST) -> None:
        kind = "any" if owner == "*" else "attr" if name is not None else "module" if owner else "own"
        key = (kind, "" if owner == "*" else owner, name if kind == "attr" else "")
        first[key] = min(first.get(key, node.lineno), node.lineno)

    for x in ast.walk(file.tree):
        if isinstance(x, ast.Attribute) and not isinstance(x.ctx, ast.Load):
            for owner in _namespace(x.value, file) or ():
                add(owner, x.attr, x)
        elif isinstance(x, ast.Subscript) and not isinstance(x.ctx, ast.Load):
            if "sys.modules" in file.dotted(x.value):
                add("*", None, x)  # another module in its place: whoever imports it next gets that
            elif isinstance(x.value, (ast.Call, ast.Attribute)) and (not isinstance(x.value, ast.Attribute) or x.value.attr in ("__dict__", "__globals__")):
                for owner in _namespace(x.value, file) or ():
                    if not isinstance(x.value, ast.Call) or file.dotted(x.value.func) & {"globals", "vars"}:
                        add(owner, _text(x.slice), x)
        elif isinstance(x, ast.Call):
            called = file.dotted(x.func)
            if called & {"setattr", "delattr"} and x.args:
                for owner in _namespace(x.args[0], file) or ():
                    add(owner, _text(x.args[1]) if len(x.args) > 1 else None, x)
            elif called & {"unittest.mock.patch", "mock.patch"}:
                owner, _, name = (_text(x.args[0]) or "").rpartition(".") if x.args else ("", "", "")
                add(owner or "*", name or None, x)
            elif called & {"unittest.mock.patch.object", "mock.patch.object"} and x.args:
                for owner in _namespace(x.args[0], file) or ["*"]:
                    add(owner, _text(x.args[1]) if len(x.args) > 1 else None, x)
    return sorted(Entry(*key, line) for key, line in first.items())


def library(found: list[Entry], dotted: str) -> bool:
    """Whether the file itself may replace a library function."""
    for e in found:
        if e.kind in ("any", "own") or e.kind == "attr" and e.name in dotted.split(".")[-2:] or e.kind == "module" and (dotted + ".").startswith(e.owner + "."):
            return True
    return False


def own_names(found: list[Entry], path: str) -> set[str] | None:
    """Names of its own module that the file may set through the module; None for all."""
    last = path.removesuffix("/__init__.py").removesuffix(".pyw").removesuffix(".py").rpartition("/")[2]
    mine = [e for e in found if not e.owner or e.owner.rpartition(".")[2] in (last, "__main__")]
    return None if any(e.kind != "attr" for e in mine) else {e.name for e in mine}
