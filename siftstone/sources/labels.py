"""Labels of benchmark files, and files of archives."""

from __future__ import annotations

import ast
import io
import posixpath
import re
import tarfile

LABEL = re.compile(r"#\s*(vuln|safe):\s*(sqli|cmdi|codei|weak_crypto)\b")
FILE_BYTES, ALL_BYTES = 5 << 20, 100 << 20


def labels(path: str, text: str) -> list[tuple[str, int, str, str, bool]]:
    """(path, line, function, class, vulnerable) of comments on a statement's first line; at most one a function, none at module level."""
    tree = ast.parse(text)
    spans = [(n.lineno, n.end_lineno, n.name) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    first = {n.lineno for n in ast.walk(tree) if isinstance(n, ast.stmt)}
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        m = LABEL.search(line)
        if not m:
            continue
        inside = [s for s in spans if s[0] <= i <= s[1]]
        if not inside or i not in first:
            raise ValueError(f"{path}:{i}: a label must stand on the first line of a statement in a function")
        name = max(inside)[2]
        if any(o[2] == name for o in out):
            raise ValueError(f"{path}:{i}: {name} has a label already")
        out.append((path, i, name, m[2], m[1] == "vuln"))
    return out


def safe_name(name: str) -> str | None:
    """The member's path if it stays inside and is a Python file."""
    path = posixpath.normpath(name)
    return None if path.startswith(("/", "../")) or path == ".." or "\\" in name or not path.endswith(".py") else path


def archived(data: bytes) -> list[tuple[str, bytes]]:
    """(path, content) of the Python files of a .tar.gz; large members and links are passed over, a large whole is refused."""
    out, total = [], 0
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        for m in tar:
            path = safe_name(m.name)
            if not m.isfile() or path is None or m.size > FILE_BYTES:
                continue
            total += m.size
            if total > ALL_BYTES:
                raise ValueError("the archive is too large")
            out.append((path, tar.extractfile(m).read()))
    return out
