"""Calls and functions around asked lines of a file, as intervals; texts are masked."""

from __future__ import annotations

import ast

from . import secrets
from .engine import decoded
from .names import File

#: End column of a call that goes on in another line.
FAR = 10**9


def spans(path: str, content: bytes | None, lines: set[int]) -> list[tuple]:
    """(kind, path, line, start, end, text, function): of asked lines the text (kind line), the calls that start there (columns; kind call) and the functions of the file (lines; kind def). Nothing of a file that is no Python."""
    try:
        file = File(path, decoded(content or b""))
    except (SyntaxError, ValueError, LookupError, RecursionError):
        return []
    masked = secrets.masked(file).splitlines()
    out = [("line", path, n, 0, 0, masked[n - 1].strip(), None) for n in sorted(lines) if 0 < n <= len(masked)]
    for x in ast.walk(file.tree):
        if isinstance(x, ast.Call) and x.lineno in lines:
            start = file.column(x.lineno, x.col_offset)
            end = file.column(x.end_lineno, x.end_col_offset) if x.end_lineno == x.lineno else FAR
            rest = masked[x.lineno - 1 : x.end_lineno]
            if len(rest) == 1:
                text = rest[0][start - 1 : end - 1]
            else:
                text = "\n".join([rest[0][start - 1 :], *rest[1:-1], rest[-1][: file.column(x.end_lineno, x.end_col_offset) - 1]])
            home = file.function_of(x)
            out.append(("call", path, x.lineno, start, end - 1, text, file.qualname.get(home) if home is not None else None))
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("def", path, 0, x.lineno, x.end_lineno, "", file.qualname.get(x)))
    return out
