"""Column functions: cleaning, paths, signatures, matching, tokens, extraction, hashing and similarity.

All are compositions of built-in functions and stay inside the JVM. "Blank" means null or the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
#: C and C++ file extensions by role.
IMPLEMENTATION = [".cc", ".cpp", ".cxx", ".cu", ".c", ".m", ".mm"]
HEADER = [".h", ".hpp", ".hxx", ".cuh", ".inc"]
SOURCE = [*HEADER, *IMPLEMENTATION]
#: How much a label of a changed function weighs.
LABEL_PRIORITY = {"root_cause_vulnerable": 3, "supporting_fix": 2, "incidental_or_unrelated": 1}
#: Line starts of commit messages that say nothing about the change.
TRAILERS = "Change-Id Reviewed-on Reviewed-by Commit-Queue Auto-Submit Cr-Commit-Position Cr-Original-Commit-Position Cr-Branched-From Bug BUG Test TEST Tested-by Signed-off-by Fixed NOPRESUBMIT".split()
CHERRY = r"(?i)\(cherry picked from commit ([0-9a-f]{7,40})\)"
HASH40 = r"\b([0-9a-f]{40})\b"
REVISION_MARK = "The following revision refers to this bug:"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SCRIPT_URL = r"const\s+url\s*=\s*[\"']([^\"']+)[\"']"
JSON_FENCED, JSON_BARE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})"
#: Text that may give away where a flaw is.
LEAKS = (
    r"(?i)(\b(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:c|cc|cpp|cxx|h|hpp|hh|hxx|m|mm|java|js|ts|py|go|rs)\b"
    r"|\b(?:[A-Za-z_~][\w<>]*::)+[A-Za-z_~][\w<>]*\b"
    r"|\b[A-Za-z_~][A-Za-z0-9_:<>.~]*\s+function\s+in\b"
    r"|\b[A-Za-z0-9_.-]+\.(?:c|cc|cpp|cxx|h|hpp|hh|hxx|m|mm|java|js|ts|py|go|rs)\b"
    r"|\b\d+\.(?:x|\d+)(?:\.(?:x|\d+)){1,4}\b"
    r"|\b(?:Windows|Linux|OS\s+X|macOS|Mac\s+OS\s+X|Mac|Android|iOS|Chrome\s?OS|ChromeOS)\b)"
)
#: Kinds of masked text, the names that answers have for them, and how they show in a text.
MASKED = ["FUNC", "FILE", "SOFTWARE_VERSION", "OS_VERSION"]
MASK_ALIASES = {
    "function": "FUNC",
    "method": "FUNC",
    "func": "FUNC",
    "filepath": "FILE",
    "path": "FILE",
    "file": "FILE",
    "filename": "FILE",
    "version": "SOFTWARE_VERSION",
    "software_version": "SOFTWARE_VERSION",
    "product_version": "SOFTWARE_VERSION",
    "os": "OS_VERSION",
    "platform": "OS_VERSION",
    "os_version": "OS_VERSION",
}
PLACEHOLDER = "<(?:FUNC|FILE|SOFTWARE_VERSION|OS_VERSION)>"
#: Signatures of test functions, and folders and files of tests.
TEST_SIGNATURE = r"::SetUp\(\)|::TearDown\(\)|\bSetUp\(\)|\bTearDown\(\)|\bTestBody\(\)|\bTEST\b|\bTEST_F\b|\bTEST_P\b|\bTYPED_TEST\b"
TEST_FOLDER = r"(?i)(^|[\\/])(test|tests|gtest|unittest)([\\/]|$)"
TEST_FILE = r"(?i)(_test|_tests|_unittest|_integrationtest)\.(c|cc|cpp|cxx|h|hpp|hh|hxx)$"
#: Commands that look into a repository's history.
HISTORY_COMMAND = r"\bgit\s+(log|show|blame|diff|stash|reflog|whatchanged|cherry(?:-pick)?|bisect|format-patch|range-diff|revert|apply)\b"
# ------------------------------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Blank handling and selection


def filled(c: Column) -> Column:
    """Null instead of the empty string."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column, default: str = "") -> Column:
    return F.coalesce(*[filled(c) for c in columns], F.lit(default))


def prefer(items: Column, wanted: Callable[[Column], Column]) -> Column:
    """The first element that is ``wanted``, else the first element, else null."""
    return F.coalesce(F.get(F.filter(items, wanted), F.lit(0)), F.get(items, F.lit(0)))


def description_in(items: Column, lang: str = "en") -> Column:
    """The text of a description array in a language, else of the first one, else ''."""
    return F.coalesce(prefer(items, lambda x: x["lang"] == lang)["value"], F.lit(""))


def primary(items: Column) -> Column:
    return prefer(items, lambda x: x["type"] == "Primary")


def status_name(c: Column) -> Column:
    return F.when(F.upper(c) == "PUBLISHED", "Published").otherwise(F.initcap(F.lower(c)))


def percent(c: Column) -> Column:
    """'12.5%' -> 0.125, null where it is no number."""
    return F.round(F.regexp_replace(F.trim(c), "%+$", "").try_cast("double") / 100, 6)


def after_first_blank(c: Column) -> Column:
    """'CWE-79 Cross site' -> 'Cross site'; '' if there is no blank."""
    return F.when(F.instr(c, " ") > 0, F.regexp_replace(c, r"^\S* ", "")).otherwise("")


def key_year(c: Column) -> Column:
    """The year in keys such as CVE-2021-1234."""
    return F.get(F.split(c, "-"), F.lit(1)).try_cast("int")


def year_between(c: Column, low: int | None, high: int | None) -> Column:
    """Years in range; a bound of None or 0 is open, a key without a year is out."""
    y = key_year(c)
    ok = y.isNotNull()
    if low:
        ok = ok & (y >= low)
    if high:
        ok = ok & (y <= high)
    return ok


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def shorten(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def joined_text(*parts: Column, by: str = " ") -> Column:
    return F.concat_ws(by, *[filled(p) for p in parts])


def remapped(c: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, c), c)


def sampled_list(items: Column, n: int, by: str = ", ") -> Column:
    """The first ``n`` elements, and how many more there are."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), by), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))


# Nested predicates


def any_product(cna: Column, vendor: str, product: str) -> Column:
    has = lambda c, word: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
    return F.coalesce(F.exists(cna, lambda x: has(x["vendor"], vendor) & has(x["product"], product)), F.lit(False))


def any_criteria(cpe: Column, text: str) -> Column:
    """Over configurations, nodes and matches."""
    nodes = F.flatten(F.transform(cpe, lambda c: F.coalesce(c["nodes"], F.array())))
    return F.coalesce(F.exists(nodes, lambda n: F.exists(n["cpeMatch"], lambda m: F.contains(F.lower(m["criteria"]), F.lit(text)))), F.lit(False))


def tagged_or_url(tags: Column, wanted: list[str], url: Column, pattern: str) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False)) | F.coalesce(url.rlike(pattern), F.lit(False))


# Paths


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "(?<=[^/])/+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """With its dot, as written; '' for none and for names that only begin with dots."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """The path without its extension."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(extension(path)))


def source_stem(path: Column) -> Column:
    """Without its extension if that is one of C or C++."""
    return F.when(F.lower(extension(path)).isin(SOURCE), stem(path)).otherwise(path)


def language(path: Column) -> Column:
    e = F.lower(extension(path))
    return F.when(e == ".c", "c").when(e.isin(SOURCE), "cpp").otherwise("")


def module(path: Column, depth: int = 2) -> Column:
    return F.array_join(F.slice(F.filter(F.split(slashes(path), "/"), lambda x: x != ""), 1, depth), "/")


def as_parent(path: Column) -> Column:
    """'a/b.cc' -> 'a/b_parent.cc'."""
    return F.concat(stem(path), F.lit("_parent"), extension(path))


def without_parent(path: Column) -> Column:
    return F.regexp_replace(path, r"_parent(\.[^./]*)?$", "$1")


def safe_path(path: Column) -> Column:
    """Relative path with '.' and '..' folded; null if it is absolute or leaves its top."""
    p = slashes(path)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("up"), F.lit(True).alias("inside")),
        lambda a, x: F.when(x != "..", F.struct(F.concat(a["up"], F.array(x)).alias("up"), a["inside"].alias("inside"))).otherwise(
            F.struct(F.slice(a["up"], 1, F.greatest(F.size(a["up"]) - 1, F.lit(0))).alias("up"), (a["inside"] & (F.size(a["up"]) > 0)).alias("inside"))
        ),
    )
    good = ~p.startswith("/") & ~p.rlike("^[A-Za-z]:")
    return let(folded, lambda f: F.when(good & f["inside"] & (F.size(f["up"]) > 0), F.array_join(f["up"], "/")))


def denied(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def mentions_test(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


# Function signatures: Qualified.Name:Return(Params); a lone colon ends the name, else the first parenthesis


def qualified_name(sig: Column) -> Column:
    lone = F.regexp_extract(sig, "^((?:[^:]|::+)*):(?!:)", 1)
    has = sig.rlike("^(?:[^:]|::+)*(?<!:):(?!:)")
    return F.trim(F.when(has, lone).otherwise(F.substring_index(sig, "(", 1)))


def bare_name(sig: Column) -> Column:
    """The last part of the name, without parameters."""
    name = F.replace(F.substring_index(qualified_name(sig), "(", 1), F.lit("::"), F.lit("."))
    return F.trim(F.substring_index(F.trim(name), ".", -1))


def name_parts(sig: Column) -> Column:
    return F.filter(F.split(qualified_name(F.replace(F.trim(sig), F.lit("::"), F.lit("."))), r"\."), lambda x: x != "")


def same_function(one: Column, other: Column) -> Column:
    last = lambda sig: F.get(F.reverse(name_parts(sig)), F.lit(0))
    return F.coalesce(last(one) == last(other), F.lit(False))


def same_file(predicted: Column, known: Column) -> Column:
    """Equal, one the other's end, or of one base name; with or without C and C++ extensions. Blank matches any."""
    trimmed = lambda c: F.regexp_replace(slashes(F.trim(c)), r"^[./]+", "")

    def alike(a: Column, b: Column) -> Column:
        return (a == b) | b.endswith(F.concat(F.lit("/"), a)) | a.endswith(F.concat(F.lit("/"), b)) | (basename(a) == basename(b))

    p, k = trimmed(predicted), trimmed(known)
    both = let(F.struct(p.alias("p"), k.alias("k"), source_stem(p).alias("ps"), source_stem(k).alias("ks")), lambda x: alike(x["p"], x["k"]) | alike(x["ps"], x["ks"]))
    return filled(predicted).isNull() | F.coalesce(both, F.lit(False))


def match_keys(file: Column, sig: Column) -> Column:
    """What ``same_file`` and ``same_function`` compare, for one item: blank, base names without and with extension, name.

    Paths of which one is the other's end have one base name.
    """
    path = F.regexp_replace(slashes(F.trim(file)), r"^[./]+", "")
    name = F.get(F.reverse(name_parts(sig)), F.lit(0))
    return let(path, lambda p: F.struct(filled(file).isNull().alias("blank"), basename(p).alias("base"), basename(source_stem(p)).alias("stem"), name.alias("name")))


def same_keys(predicted: Column, known: Column) -> Column:
    alike = (predicted["base"] == known["base"]) | (predicted["stem"] == known["stem"])
    return F.coalesce(predicted["name"] == known["name"], F.lit(False)) & (predicted["blank"] | F.coalesce(alike, F.lit(False)))


# Tokens


def identifier_tokens(text: Column) -> Column:
    """Lower-case parts of two or more characters of identifiers; camel case is split unless a word is of one case."""
    words = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9]*)"), 1), lambda w: F.length(w) > 1)
    one_case = lambda w: (w == F.upper(w)) | (w == F.lower(w))
    parts = F.transform(words, lambda w: F.when(one_case(w), F.array(F.lower(w))).otherwise(F.transform(F.split(w, CAMEL), F.lower)))
    return F.filter(F.flatten(parts), lambda w: F.length(w) > 1)


def word_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words of two or more word characters, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), 1)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


# Extraction from texts


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def cherry_sources(message: Column) -> Column:
    return F.transform(all_matches(message, CHERRY), F.lower)


def canonical_message(message: Column) -> Column:
    """Without cherry-pick notes and trailer lines, in single white space."""
    plain = F.regexp_replace(F.coalesce(message, F.lit("")), CHERRY, "")
    return squeeze(F.regexp_replace(plain, f"(?m)^(?:{'|'.join(TRAILERS)}):.*$", ""))


def marked_links(text: Column, mark: str = REVISION_MARK) -> Column:
    """The first URL behind each mark: array<struct<url,hash,tag>>, where it names a git commit or an svn revision."""
    tails = F.slice(F.split(text, r"\Q" + mark + r"\E"), 2, 1_000_000)
    # a mark with no URL before the next mark takes the next one's, as the text goes on
    urls = F.transform(tails, lambda t, i: F.regexp_extract(F.array_join(F.slice(tails, i + 1, F.size(tails)), " "), r"(https?://[^\s<>\"]+)", 1))

    def link(u: Column) -> Column:
        git = F.regexp_extract(u, r"chromium\.googlesource\.com/chromium/src(?:\.git)?/\+/([0-9a-f]{40})", 1)
        svn = F.regexp_extract(u, r"src\.chromium\.org/.*?[?&]rev(?:ision)?=(\d+)", 1)
        return F.struct(u.alias("url"), F.coalesce(filled(git), filled(svn)).alias("hash"), F.when(git != "", "git").when(svn != "", "svn").alias("tag"))

    return F.filter(F.transform(F.filter(urls, lambda u: u != ""), link), lambda x: x["tag"].isNotNull())


def project_blocks(text: Column, within: int = 2000) -> Column:
    """Behind each 'Project: chromium/src' line: the commit hash in the next characters, else the Link: URL."""
    tails = F.slice(F.split(text, r"Project:\s*chromium/src"), 2, 1_000_000)

    def block(t: Column) -> Column:
        t = F.substring(t, 1, within)
        commit = F.regexp_extract(t, r"(?i)commit\s+([0-9a-f]{40})", 1)
        url = F.regexp_extract(t, r"Link:\s*(https?://\S+)", 1)
        return F.struct(filled(commit).alias("hash"), F.when(commit == "", filled(url)).alias("url"), F.when(commit != "", "raw").when(F.contains(url, F.lit("-review.")), "review").when(url != "", "git").alias("tag"))

    return F.filter(F.transform(tails, block), lambda x: x["tag"].isNotNull())


def change_number(url: Column) -> Column:
    """Number of a review: /c/project/+/n, /+/n, /c/n or /n, the first that fits."""
    forms = [r"/c/[^?#]+?/\+/(\d+)", r"/\+/(\d+)", r"/c/(\d+)", r"//[^/]+/(\d+)"]
    return F.coalesce(*[filled(F.regexp_extract(url, f, 1)) for f in forms])


def script_redirect(body: Column) -> Column:
    """Where a page's script sends the reader: const url = "..."."""
    return filled(F.regexp_extract(body, SCRIPT_URL, 1))


def git_svn_id(message: Column) -> Column:
    """Path root and revision of a git-svn-id line."""
    url = r"git-svn-id:\s*(\S+?)@(\d+)"
    return F.struct(filled(F.regexp_extract(message, url, 1)).alias("svn_root"), F.regexp_extract(message, url, 2).try_cast("long").alias("revision"))


def json_in_answer(text: Column) -> Column:
    """The JSON text of a model's answer: without code fences, else from the first brace to the last; null if invalid."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: let(c, lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).rlike("^(OBJECT|ARRAY)<"), t))
    return F.coalesce(ok(bare), ok(inner))


def last_json(text: Column, key: str | None = None) -> Column:
    """The last valid JSON object of a transcript (with ``key``): fenced blocks first, then bare ones of one level of nesting."""
    fenced = F.regexp_extract_all(text, F.lit(JSON_FENCED), 1)
    bare = F.regexp_extract_all(text, F.lit(JSON_BARE), 1)
    fits = lambda x: F.try_parse_json(x).isNotNull() if key is None else F.array_contains(F.json_object_keys(x), key) & F.try_parse_json(x).isNotNull()
    good = lambda a: F.get(F.reverse(F.filter(a, lambda x: F.coalesce(fits(x), F.lit(False)))), F.lit(0))
    return F.coalesce(good(fenced), good(bare))




def maybe_leaks(text: Column) -> Column:
    return F.coalesce(text.rlike(LEAKS), F.lit(False))


def placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLACEHOLDER))


# Hashes and shards


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def md5_shard(key: Column, shards: int) -> Column:
    """The 128-bit MD5 value modulo ``shards``, folded digit by digit."""
    digits = F.transform(F.filter(F.split(F.md5(key), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % shards)


# Similarity


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def label_similarity(a: Column, b: Column) -> Column:
    """Equal 1, contained .9, both blank .6, one blank .5, else by edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    blank = lambda c: c == ""
    return (
        F.when(blank(a) & blank(b), 0.6)
        .when(blank(a) | blank(b), 0.5)
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.9)
        .otherwise(1 - F.levenshtein(a, b) / longest)
    )


def set_jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(1.0))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger ones."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    names = F.array_union(a, b)
    total = lambda f: F.aggregate(F.transform(names, lambda x: f(count(a, x), count(b, x))), F.lit(0), lambda s, n: s + n)
    return F.coalesce(F.try_divide(total(F.least).cast("double"), total(F.greatest).cast("double")), F.lit(1.0))


def match_threshold(size: Column, depth: Column) -> Column:
    """How alike subtrees must be: less for large and deep ones, within [0.40, 0.70]."""
    t = 0.60 - 0.05 * F.log(F.greatest(size.cast("double"), F.lit(1.0))) - 0.02 * F.least(depth.cast("double"), F.lit(16.0))
    return F.greatest(F.lit(0.40), F.least(F.lit(0.70), t))


def idf_bm25(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def idf_smooth(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1

# Records and lists


def is_expected(found: Column, expected: Column) -> Column:
    """An id that is there and is the expected one, whatever its case."""
    return F.coalesce((F.trim(found) != "") & (F.upper(F.trim(found)) == F.upper(F.trim(expected))), F.lit(False))


def record_key(position: Column, *ids: Column) -> Column:
    """The first filled id, else 'line:<n>'."""
    return F.coalesce(*[filled(F.trim(c)) for c in ids], F.concat(F.lit("line:"), position.cast("string")))


def issue_key(issue_id: Column, link: Column, position: Column) -> Column:
    """The id, else the last part of the link, else the position."""
    return F.coalesce(filled(F.trim(issue_id)), filled(F.regexp_extract(link, "([^/]+)/*$", 1)), position.cast("string"))


def function_list(json: Column) -> Column:
    """A JSON array of signatures or of {sig, code} objects as array<struct<sig,code>>; blank signatures go."""
    items = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))

    def one(x: Column) -> Column:
        v = F.try_parse_json(x)
        object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return F.struct(F.when(object_, F.try_variant_get(v, "$.sig", "string")).otherwise(x).alias("sig"), F.when(object_, F.try_variant_get(v, "$.code", "string")).alias("code"))

    return F.filter(F.transform(items, one), lambda x: F.coalesce(x["sig"], F.lit("")) != "")


def document_text(file: Column, body: Column, sig: Column, most: int | None = None) -> Column:
    """What a function is found by: its file and its body, else its signature."""
    text = F.coalesce(filled(body), sig)
    return F.concat_ws(" ", file, F.substring(text, 1, most) if most else text)


def content_variant(choice: str, cve: Column, restated_: Column, issue: Column) -> Column:
    """One of the texts, or both the restated text (else the plain one) and the issue."""
    if choice == "both":
        return joined_text(first_filled(restated_, cve), issue, by="\n\n")
    return F.coalesce({"cve": cve, "restated": restated_, "issue": issue}[choice], F.lit(""))


def without_repeats(items: Column) -> Column:
    """Elements that differ from the one before."""
    return F.filter(items, lambda x, i: ~x.eqNullSafe(F.get(items, i - 1)) | (i == 0))


def without_endings(c: Column, endings: list[str], nothing: str = "--") -> Column:
    """A scraped value without known endings; the sign for nothing is ''."""
    out = F.trim(c)
    for e in endings:
        out = F.trim(F.regexp_replace(out, r"\Q" + e + r"\E$", ""))
    return F.when(out == nothing, "").otherwise(out)


def template(text: str, **values: Column) -> Column:
    """A text with {names} filled in by columns, blank where they are null."""
    import re

    parts = re.split(r"(\{\w+\})", text)
    return F.concat(*[F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in parts])


def for_each(items: Column, line: Callable[[Column, Column], Column], by: str = "\n") -> Column:
    """A line for each element, with its number from 1."""
    return F.array_join(F.transform(items, lambda x, i: line(x, i + 1)), by)



def is_test_signature(sig: Column) -> Column:
    return F.coalesce(sig.rlike(TEST_SIGNATURE), F.lit(False))


def is_test_path(path: Column) -> Column:
    """A file in a folder of tests, or named like one."""
    folder = F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)
    return F.coalesce(folder.rlike(TEST_FOLDER) | path.rlike(TEST_FILE), F.lit(False))


def none_contains(items: Column, part: str) -> Column:
    """No element has the part; so it is for null and empty arrays."""
    return ~F.coalesce(F.exists(items, lambda x: F.contains(x, F.lit(part))), F.lit(False))


def without_class_macros(code: Column) -> Column:
    """'class EXPORT_MACRO Foo' -> 'class Foo', and macros between a parameter list and its body."""
    out = F.regexp_replace(code, r"\b(class|struct)\s+[A-Z][A-Z0-9_]{2,}(?:\([^()]*\))?\s+(?=\w)", "$1 ")
    return F.regexp_replace(out, r"\)\s+[A-Z][A-Z0-9_]{3,}(?:\([^()]*\))?\s*\{", ") {")


def subtree_similarity(name: Column, size_ratio: Column, cover: Column) -> Column:
    return 0.30 * name + 0.40 * cover + 0.30 * size_ratio


def keeps_mapping(name: Column, size_ratio: Column, cover: Column) -> Column:
    """Whether a pair of subtrees that was matched is alike enough to be kept."""
    strict = (name >= 0.85) & (cover >= 0.35) & (size_ratio >= 0.30)
    covered = (cover >= 0.55) & (size_ratio >= 0.30)
    balanced = (name >= 0.70) & (size_ratio >= 0.50) & (cover >= 0.40)
    return strict | covered | balanced | (0.45 * name + 0.15 * size_ratio + 0.40 * cover >= 0.60)
