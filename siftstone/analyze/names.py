"""Lexical scopes of a Python file: which dotted names an expression may stand for."""

from __future__ import annotations

import ast
from collections import Counter, defaultdict

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class Scope:
    """Names bound in one scope: name -> set of dotted import targets, with None for any other binding."""

    def __init__(self, node: ast.AST, parent: Scope | None):
        self.node, self.parent = node, parent
        self.bound: dict[str, set[str | None]] = defaultdict(set)
        self.declared: dict[str, str] = {}
        self.stars: set[str] = set()

    @property
    def is_class(self) -> bool:
        return isinstance(self.node, ast.ClassDef)


class File:
    """A parsed file with its scopes, the qualified names of its functions and the parents of its nodes."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.lines = path, text, text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.tree = ast.parse(text)
        self.scope_of: dict[ast.AST, Scope] = {}
        self.parent: dict[ast.AST, ast.AST] = {}
        self.qualname: dict[ast.AST, str] = {}
        self.stored_attributes: set[str] = set()
        #: What the file may replace (analyze/replaced.py); whoever analyses it puts it here.
        self.replaced: list = []
        #: Names of its module that it may set through the module; None for all.
        self.reset: set[str] | None = set()
        # Indexes, so that rules need no walk over the tree: what names are given, how often they are bound, calls of their update().
        self.given: dict[str, list[tuple[ast.AST, ast.expr]]] = defaultdict(list)
        self.bindings: Counter = Counter()
        self.updates: dict[str, list[ast.Call]] = defaultdict(list)
        #: Whether code of this file may write any name of the module.
        self.exposed = False
        #: Secrets that texts must not show, the longest first.
        self.hidden: tuple[str, ...] = ()
        top = Scope(self.tree, None)
        self.module = top
        self._walk(self.tree, top, "")

    def _walk(self, node: ast.AST, scope: Scope, name: str) -> None:
        for child in ast.iter_child_nodes(node):
            self._visit(child, node, scope, name)

    def _visit(self, node: ast.AST, parent: ast.AST, scope: Scope, name: str) -> None:
        self.parent[node], self.scope_of[node] = parent, scope
        self._index(node, scope)
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            own = getattr(node, "name", "<lambda>")
            if not isinstance(node, ast.Lambda):
                self.bind(scope, own, None)
            self.qualname[node] = name + own
            inner = Scope(node, scope)
            outside = [*getattr(node, "decorator_list", []), *getattr(node, "bases", []), *getattr(node, "keywords", [])]
            arguments = getattr(node, "args", None)
            if arguments is not None:
                outside += [*arguments.defaults, *(d for d in arguments.kw_defaults if d)]
                every = [*arguments.posonlyargs, *arguments.args, *arguments.kwonlyargs, *filter(None, (arguments.vararg, arguments.kwarg))]
                outside += [a.annotation for a in every if a.annotation]
                for a in every:
                    inner.bound[a.arg].add(None)
            if getattr(node, "returns", None):
                outside.append(node.returns)
            for x in outside:
                self._visit(x, node, scope, name)
            body = [node.body] if isinstance(node, ast.Lambda) else node.body
            prefix = f"{name}{own}." if isinstance(node, ast.ClassDef) else f"{name}{own}.<locals>."
            for x in body:
                self._visit(x, node, inner, prefix)
            return
        if isinstance(node, COMPREHENSIONS):
            inner = Scope(node, scope)
            for i, g in enumerate(node.generators):
                self._visit(g.iter, node, scope if i == 0 else inner, name)
                self._visit(g.target, node, inner, name)
                for x in g.ifs:
                    self._visit(x, node, inner, name)
            for x in [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]:
                self._visit(x, node, inner, name)
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                self.bind(scope, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                origin = self.origin(node)
                if a.name == "*":
                    scope.stars.add(".." if origin is None else origin)
                else:
                    self.bind(scope, a.asname or a.name, None if origin is None else f"{origin}.{a.name}")
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            for x in node.names:
                scope.declared[x] = "global" if isinstance(node, ast.Global) else "nonlocal"
        elif isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
            target = scope
            while isinstance(parent, ast.NamedExpr) and isinstance(target.node, COMPREHENSIONS):
                target = target.parent
            self.bind(target, node.id, None)
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Store):
            self.stored_attributes.add(node.attr)
        elif isinstance(node, ast.ExceptHandler) and node.name or isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            self.bind(scope, node.name, None)
        self._walk(node, scope, name)

    def _index(self, node: ast.AST, scope: Scope) -> None:
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.given[t.id].append((node, node.value))
        elif isinstance(node, (ast.AnnAssign, ast.NamedExpr)):
            if isinstance(node.target, ast.Name) and node.value:
                self.given[node.target.id].append((node, node.value))
        elif isinstance(node, ast.With):
            for i in node.items:
                if isinstance(i.optional_vars, ast.Name):
                    self.given[i.optional_vars.id].append((node, i.context_expr))
        elif isinstance(node, ast.Call):
            func = node.func
            if isinstance(func, ast.Attribute) and func.attr == "update" and isinstance(func.value, ast.Name):
                self.updates[func.value.id].append(node)
            elif isinstance(func, ast.Name):
                self.exposed |= func.id == "globals" or func.id == "vars" and not node.args or func.id in ("exec", "locals") and scope is self.module

    def origin(self, node: ast.ImportFrom) -> str | None:
        """The dotted module that names come from, relative ones by the file's package; None above the root.

        Below the root itself, whose package has no name, it starts with a dot, so that no outside module is meant.
        """
        if not node.level:
            return node.module
        package = self.path.split("/")[:-1]
        up = node.level - 1
        if up > len(package):
            return None
        return ".".join([*(package[: len(package) - up] or [""]), *([node.module] if node.module else [])])

    def bind(self, scope: Scope, name: str, target: str | None) -> None:
        self.bindings[name] += 1
        how = scope.declared.get(name)
        if how == "global":
            scope = self.module
        elif how == "nonlocal":
            outer = scope.parent
            while outer and (outer.is_class or name not in outer.bound):
                outer = outer.parent
            scope = outer or scope
        scope.bound[name].add(target)

    def owner(self, name: str, scope: Scope) -> Scope | None:
        """The scope whose binding a use of name in scope sees; class scopes are not seen from inside functions."""
        if scope.declared.get(name) == "global":
            return self.module if name in self.module.bound else None
        at, first = scope, True
        while at:
            if name in at.bound and (first or not at.is_class):
                return at
            first, at = False, at.parent
        return None

    def dotted(self, node: ast.AST) -> set[str]:
        """Dotted names that an expression may stand for; empty if it is a local value."""
        if isinstance(node, ast.Name):
            scope = self.scope_of.get(node, self.module)
            owner = self.owner(node.id, scope)
            if owner is None:
                return {node.id, *(f"{m}.{node.id}" for m in self.module.stars)}
            return {t for t in owner.bound[node.id] if t}
        if isinstance(node, ast.Attribute):
            return {f"{b}.{node.attr}" for b in self.dotted(node.value)}
        return set()

    def function_of(self, node: ast.AST) -> ast.AST | None:
        while node in self.parent:
            node = self.parent[node]
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                return node
        return None

    def assignments(self, name: str, node: ast.AST) -> list[ast.expr]:
        """Values assigned to name before node in the same function; else those at module level."""
        where = self.function_of(node) or self.tree
        for home in dict.fromkeys((where, self.tree)):
            found = [value for x, value in self.given[name] if x.lineno <= node.lineno and (self.function_of(x) or self.tree) is home]
            if found:
                return found
        return []

    def shown(self, node: ast.AST) -> str:
        """The node's code in one spelling, without secrets."""
        return self.without_secrets(ast.unparse(node))

    def without_secrets(self, text: str) -> str:
        for s in self.hidden:
            text = text.replace(s, "<REDACTED>")
        return text

    def segment(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def column(self, line: int, offset: int) -> int:
        """1-based column in characters of a byte offset."""
        return len(self.lines[line - 1].encode()[:offset].decode("utf-8", "replace")) + 1
