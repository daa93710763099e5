"""Redaction, control characters, entropy, globs, columns of characters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<REDACTED>"
SHORTEST_SECRET = 4
# Patterns in the syntax that Java, RE2 and Python share.
LITERAL = r"'(?:\\.|[^'\\])+'|\"(?:\\.|[^\"\\])+\""
CONTROLS = [*range(0x00, 0x09), *range(0x0B, 0x20), *range(0x7F, 0xA0)]
SECRET_NAME = r"(?i)(key|token|secret|passw|pwd|credential|auth)"
#: Directories that a scan never enters.
IGNORED = (".git", ".hg", ".svn", ".venv", "venv", "env", ".env", ".tox", ".nox", "node_modules", "build", "dist", "site-packages", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".eggs", "*.egg-info")


def redact(text: Column, secrets: Column, literals: bool = False, tool_secrets: Column | None = None) -> Column:
    """Replace known secrets, the longest first, ties in text order; secrets of tools may be of any length."""
    known = F.filter(secrets, lambda s: F.length(s) >= SHORTEST_SECRET)
    if tool_secrets is not None:
        known = F.array_union(known, F.filter(tool_secrets, lambda s: F.length(s) > 0))
    order = F.array_sort(F.transform(F.array_distinct(known), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    out = F.aggregate(order, text, lambda t, s: F.replace(t, s["s"], F.lit(REDACTED)))
    return redact_literals(out) if literals else out


def redact_literals(text: Column) -> Column:
    single = F.regexp_replace(text, r"'(?:\\.|[^'\\])+'", f"'{REDACTED}'")
    return F.regexp_replace(single, r'"(?:\\.|[^"\\])+"', f'"{REDACTED}"')


def redact_code(text: Column, secrets: Column) -> Column:
    """Literals and assigned values removed, line by line."""
    return F.array_join(F.transform(F.split(redact(text, secrets, literals=True), "\n", -1), lambda line: F.regexp_replace(line, r"([=:]\s*)[^\s#'\"][^#]*?(\s*(?:#.*)?)$", f"$1{REDACTED}$2")), "\n")


# A literal that is given to a name, and a long literal of key characters; in the syntax that Java and RE2 share.
ASSIGNED_LITERAL = r"""[A-Za-z_][A-Za-z0-9_.]*\s*[:=]\s*(?:'(?:\\[^\n]|[^'\\\n])*'|"(?:\\[^\n]|[^"\\\n])*")"""
LONG_LITERAL = r"""'[A-Za-z0-9+/=_-]{20,}'|"[A-Za-z0-9+/=_-]{20,}\""""
#: Bits a character from which a long literal is taken for a secret.
RANDOM = 3.5


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body names it: inside a lambda nothing else is shared."""
    return F.transform(F.array(value), body)[0]


def splice(text: Column, pattern: str, decide: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern replaced by decide(match): the gaps and the matches, joined again in order. Each row is split and searched once, whatever the number of matches."""

    def joined(t):
        gaps, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        # A match stands before its gap, none before the first.
        both = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), hits).alias("hit"), gaps.alias("gap"))
        return F.array_join(F.transform(both, lambda x: F.concat(F.coalesce(F.when(x["hit"].isNotNull(), decide(x["hit"])), F.lit("")), x["gap"])), "")

    return once(text, lambda t: F.when(F.regexp_like(t, F.lit(pattern)), joined(t)).otherwise(t))


def redact_secretish(text: Column, known: Column | None = None) -> Column:
    """For texts that leave in raw form: known values, literals given to secret-looking names, and long literals that look random."""
    out = redact(text, F.array().cast("array<string>"), tool_secrets=known) if known is not None else text

    def named(match: Column) -> Column:
        name = F.regexp_extract(match, r"^[A-Za-z_][A-Za-z0-9_.]*", 0)
        return F.when(name.rlike(SECRET_NAME), F.regexp_replace(match, r"(?s)(['\"]).*$", f"$1{REDACTED}$1")).otherwise(match)

    def random(match: Column) -> Column:
        quote = F.left(match, F.lit(1))
        return F.when(entropy(F.substring(match, F.lit(2), F.length(match) - 2)) >= RANDOM, F.concat(quote, F.lit(REDACTED), quote)).otherwise(match)

    return splice(splice(out, ASSIGNED_LITERAL, named), LONG_LITERAL, random)


def strip_controls(text: Column) -> Column:
    """C0 and C1 controls but tab and newline as \\xNN. Texts without any (nearly all) are not looked at twice."""
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\x{c:02x}"))
    return F.when(F.regexp_like(text, F.lit(r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}]")), out).otherwise(text)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text. One sort of the characters, then one pass over the ends of their runs."""

    def ends(chars):
        return F.filter(F.transform(chars, lambda c, i: F.when((i + 1 == F.size(chars)) | (c != F.get(chars, i + 1)), i + 1)), lambda e: e.isNotNull())

    def bits(ends):
        n = F.element_at(ends, -1).cast("double")
        shares = F.transform(ends, lambda e, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(0))) / n)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(F.length(text) > 0, once(once(F.array_sort(chars), ends), bits)).otherwise(F.lit(0.0))


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression for whole strings; * and ? cross slashes."""
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def ignored(path: Column, patterns: tuple[str, ...] = (), directories: tuple[str, ...] = IGNORED) -> Column:
    """Whether a path lies in an ignored directory, or a pattern matches it, a parent of it, or (without /) a component."""
    parts = F.split(path, "/")
    parents = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hit = F.lit(False)
    for d in directories:
        hit = hit | _any_like(parents, glob_regex(d))
    for raw in patterns:
        p = raw.strip().rstrip("/")
        if not p:
            continue
        whole = [p, p + "/*"] + ([p[3:], p[3:] + "/*"] if p.startswith("**/") else [])
        for w in whole:
            hit = hit | path.rlike(glob_regex(w))
        if "/" not in p:
            hit = hit | _any_like(parts, glob_regex(p))
    return hit


def _any_like(parts: Column, regex: str) -> Column:
    return F.exists(parts, lambda x: x.rlike(regex))


def char_column(line: Column, byte_offset: Column) -> Column:
    """1-based column of characters for a UTF-8 byte offset."""
    return F.length(F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte_offset), "UTF-8")) + 1


def source_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n", -1)


def module_name(path: Column) -> Column:
    """Dotted module of a Python file; a package's __init__ is the package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.pyw?$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))
