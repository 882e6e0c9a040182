"""Source code: comments, preprocessor branches, functions, and differences between two versions.

Scanning code needs state, so the scanners are Python behind Arrow batches; everything around them is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.columns import bare_name, squeeze
from lodestrata.sources.shared import kept, ship

_LITERAL = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|R"([^\s()\\]{0,16})\(.*?\)\1"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b", re.M)
_TEST_MACRO = re.compile(r"\b(?:TEST|TEST_F|TEST_P|TYPED_TEST|TYPED_TEST_P|IN_PROC_BROWSER_TEST_F|IN_PROC_BROWSER_TEST_P|INSTANTIATE_TEST_SUITE_P|BENCHMARK)\b")
_NOT_A_FUNCTION = frozenset("if for while switch catch return sizeof else do defined alignof decltype static_assert new delete throw".split())
_HEAD = re.compile(r"([~\w:<>,\*&\s\[\]]*?)((?:[A-Za-z_]\w*(?:<[^<>(){};]*>)?::)*~?[A-Za-z_]\w*|operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+))\s*\(", re.S)


def strip_comments(code: str) -> str:
    """Comments become one blank, their line ends stay; literals stay as they are."""
    return _LITERAL.sub(lambda m: " " + "\n" * m[0].count("\n") if m[0][:2] in ("//", "/*") else m[0], code)


def _live(code: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether each is code of a first branch."""
    stack: list[int] = []
    for line in code.split("\n"):
        m = _DIRECTIVE.match(line)
        word = m[1] if m else None
        if word in ("if", "ifdef", "ifndef"):
            stack.append(0)
        elif word in ("elif", "else") and stack:
            stack[-1] += 1
        yield line, not word and not any(stack)
        if word == "endif" and stack:
            stack.pop()


def first_branches(code: str) -> str:
    """Of each conditional the first branch stays; directives and other branches' lines become comments."""
    return "\n".join(line if live else f"// {line}" for line, live in _live(code))


def _blanked(code: str) -> str:
    """Same length; comments, literals, directives and branches but the first are blanks, so that braces count."""
    s = _LITERAL.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    s = "\n".join(line if live else " " * len(line) for line, live in _live(s))
    return re.sub(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", lambda m: re.sub(r"[^\n]", " ", m[0]), s, flags=re.M)


def _close(s: str, at: int, pair: str) -> int:
    depth = 0
    for i in range(at, len(s)):
        if s[i] == pair[0]:
            depth += 1
        elif s[i] == pair[1]:
            depth -= 1
            if not depth:
                return i
    return -1


def _type(text: str) -> str:
    return re.sub(r"\s*([*&]+)\s*", r"\1", re.sub(r"\s+", " ", text).strip()).strip()


def _parameters(text: str) -> str:
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    parts.append(now)
    out = []
    for p in parts:
        p = re.sub(r"\s+", " ", p.split("=")[0]).strip()
        m = re.match(r"^(.*[\s*&>])([A-Za-z_]\w*)(\s*\[\s*\w*\s*\])?$", p)
        out.append(_type((m[1] if m else p) + (m[3] or "" if m else "")))
    return ",".join(x for x in out if x and x != "void")


def functions(code: str) -> list[tuple[str, str, int, int]]:
    """(sig, body, first line, last line) of function definitions, names qualified by their namespaces and classes.

    A signature is Qualified.Name:Return(Parameter types); constructors and destructors have no return type.
    """
    s, out = _blanked(code), []
    scopes: list[tuple[str, int]] = []  # name, end
    i, begin = 0, 0
    while i < len(s):
        c = s[i]
        while scopes and i > scopes[-1][1]:
            scopes.pop()
        if c in ";}":
            begin = i + 1
        elif c == "{":
            end = _close(s, i, "{}")
            if end < 0:
                break
            head = s[begin:i]
            scope = re.search(r"\b(namespace|class|struct|union|enum)\b((?:(?!\b(?:namespace|class|struct|union)\b)[^(){};=])*)$", head)
            if 'extern' in head and not head.replace("extern", "").strip():
                begin = i + 1
                i += 1
                continue
            if scope and scope[1] != "enum":
                words = re.findall(r"[A-Za-z_]\w*(?:::\w+)*", scope[2].split(":")[0] if "::" not in scope[2] else re.split(r"(?<!:):(?!:)", scope[2])[0])
                words = [w for w in words if w not in ("final", "inline", "alignas")]
                scopes.append((words[-1].replace("::", ".") if words else "__anon__", end))
                begin = i + 1
                i += 1
                continue
            m = _HEAD.search(re.sub(r"^\s*(?:(?:public|private|protected)\s*:|template\s*<[^{;]*?>(?=\s*[\w~]))", lambda x: " " * len(x[0]), head))
            if m and m[2] not in _NOT_A_FUNCTION and not (scope and scope[1] == "enum"):
                opening = begin + m.end() - 1
                closing = _close(s, opening, "()")
                if 0 < closing < i and re.fullmatch(r"[\s\w:,<>&*()~.\-\[\]={}]*", s[closing + 1 : i]):
                    name = re.sub(r"\s+", "", m[2]) if not m[2].startswith("operator ") else m[2]
                    parts = [x for x, _ in scopes] + re.sub(r"<[^<>]*>", "", name).replace("::", ".").split(".")
                    returned = _type(re.sub(r"\b(?:static|inline|virtual|explicit|constexpr|extern|friend|public|private|protected)\b:?", "", m[1]))
                    short = parts[-1]
                    owner = parts[-2] if len(parts) > 1 else None
                    if not _TEST_MACRO.fullmatch(short):
                        special = short.startswith("~") or short == owner
                        shown = code[opening + 1 : closing]
                        sig = ".".join(parts) + ":" + ("" if special else returned) + f"({_parameters(strip_comments(shown))})"
                        lead = begin + len(s[begin : begin + m.start(1)]) + (len(m[1]) - len(m[1].lstrip()))
                        lead = lead if m[1].strip() else begin + m.start(2)
                        out.append((sig, code[lead : end + 1], code.count("\n", 0, lead) + 1, code.count("\n", 0, end) + 1))
                i = end
                begin = i + 1
            elif re.search(r"[=,(]\s*$", head):
                i = end  # an initialiser
            else:
                i = end
                begin = i + 1
        i += 1
    return out


def _per_row(df: DataFrame, keys: list[str], code: str, columns: str, each) -> DataFrame:
    ship(df.sparkSession)
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = lru_cache(256)(each)  # versions of a file are often the same text
        for b in batches:
            rows = [(*k, *r) for *k, text in zip(*[b[x] for x in keys], b[code], strict=True) for r in (seen if len(text or "") < 65_536 else each)(text or "")]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, code).mapInPandas(run, f"{types}, {columns}")


def function_table(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """keys, idx, sig, body, line_start, line_end of the functions in each row's code."""
    return _per_row(df, keys, code, "idx int, sig string, body string, line_start int, line_end int", lambda t: [(i, *f) for i, f in enumerate(functions(t))])


def clean_code(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """keys and code without comments, with first preprocessor branches only; status tells if anything is left."""
    return _per_row(df, keys, code, "cleaned string, status string", lambda t: [(c := strip_comments(first_branches(t)), "ok" if c.strip() else "empty")])


def function_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Functions (keys, sig, body) that were added, removed or modified between two versions.

    Equal signatures with other bodies are modified. Of the rest, a removed and an added function of one file are one
    modified function if they share their bare name and each has only that partner, or else the fewest edits between
    their signatures, mutually.
    """
    a = old.groupBy(*keys, "sig").agg(F.min("body").alias("code"))
    b = new.groupBy(*keys, "sig").agg(F.min("body").alias("code_after"))
    met = a.withColumn("old_sig", F.col("sig")).join(b.withColumn("new_sig", F.col("sig")), [*keys, "sig"], "full")
    met = kept(met, "functions")  # read for each kind of change, scanned once
    changed = met.where("old_sig is not null and new_sig is not null").where(F.sha1(squeeze(F.col("code"))) != F.sha1(squeeze(F.col("code_after"))))
    gone = met.where("new_sig is null").select(*keys, "old_sig", "code", bare_name(F.col("old_sig")).alias("name_"))
    come = met.where("old_sig is null").select(*keys, "new_sig", "code_after", bare_name(F.col("new_sig")).alias("name_"))
    near = gone.join(come, [*keys, "name_"]).withColumn("d", F.levenshtein("old_sig", "new_sig"))
    best_old = near.groupBy(*keys, "old_sig").agg(F.min_by("new_sig", F.struct("d", "new_sig")).alias("new_sig"))
    best_new = near.groupBy(*keys, "new_sig").agg(F.min_by("old_sig", F.struct("d", "old_sig")).alias("old_sig"))
    moved = best_old.join(best_new, [*keys, "old_sig", "new_sig"])
    renamed = gone.join(moved, [*keys, "old_sig"]).join(come.drop("name_"), [*keys, "new_sig"])
    columns = [*keys, "category", "sig", "new_sig", "code", "code_after"]
    null = F.lit(None).cast("string")
    parts = [
        changed.select(*keys, F.lit("modified").alias("category"), "sig", "new_sig", "code", "code_after"),
        renamed.select(*keys, F.lit("modified").alias("category"), F.col("old_sig").alias("sig"), "new_sig", "code", "code_after"),
        gone.join(moved, [*keys, "old_sig"], "left_anti").select(*keys, F.lit("removed").alias("category"), F.col("old_sig").alias("sig"), null.alias("new_sig"), "code", null.alias("code_after")),
        come.join(moved, [*keys, "new_sig"], "left_anti").select(*keys, F.lit("added").alias("category"), F.col("new_sig").alias("sig"), "new_sig", null.alias("code"), "code_after"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*columns)


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each point (keys, line) with the smallest span (keys, sig, line_start, line_end) that holds it."""
    met = points.join(spans, keys).where("line >= line_start and line <= line_end")
    at = F.struct((F.col("line_end") - F.col("line_start")).alias("size"), F.col("line_start"), F.col("sig"))
    return met.groupBy(*keys, "line").agg(F.min_by("sig", at).alias("sig"))


def greedy_matches(pairs: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs (keys, a, b, score) that are each other's best among those left, in rounds, until none is left.

    Every round takes all mutually best pairs at once, which is what taking the best pair of all, again and again, gives.
    """
    left, out = kept(pairs.where(F.col("score") >= least)), None
    while not left.isEmpty():
        top_a = left.groupBy(*keys, "a").agg(F.max_by("b", F.struct("score", "a", "b")).alias("b"))
        top_b = left.groupBy(*keys, "b").agg(F.max_by("a", F.struct("score", "a", "b")).alias("a"))
        best = kept(top_a.join(top_b, [*keys, "a", "b"]).join(left, [*keys, "a", "b"]))
        out = best if out is None else out.unionByName(best)
        if best.isEmpty():
            break
        left = kept(left.join(best.select(*keys, "a"), [*keys, "a"], "left_anti").join(best.select(*keys, "b"), [*keys, "b"], "left_anti"))
    return pairs.where("1 = 0") if out is None else out.select(*pairs.columns)
