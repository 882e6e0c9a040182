"""Model calls and other external work behind a client: cache, retries, validation, stages, transcripts.

A client is a function of (key, prompt) rows to answers. None is built in: without one a row has the status
"skipped" and its text stays as it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.columns import HISTORY_COMMAND, MASK_ALIASES, json_in_answer, last_json, let, maybe_leaks, placeholders

Client = Callable[[str, str], str]


def call(df: DataFrame, key: str, prompt: str, client: Client | None, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """key, answer, status (ok, error, skipped), attempts, error for each row."""
    if client is None:
        return df.select(key, F.lit(None).cast("string").alias("answer"), F.lit("skipped").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[prompt], strict=True):
                answer, error, attempt = None, None, 0
                while attempt < retries and answer is None:
                    attempt += 1
                    try:
                        answer, error = client(k, p), None
                    except Exception as e:  # noqa: BLE001  whatever a client raises is its answer's status
                        error = str(e)[-800:]
                        time.sleep(wait * 2**attempt)
                rows.append((k, answer, "ok" if answer is not None else "error", attempt, error))
            yield pd.DataFrame(rows, columns=[key, "answer", "status", "attempts", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, status string, attempts int, error string")


def cached_call(df: DataFrame, key: str, prompt: str, cache: DataFrame, client: Client | None, **options) -> tuple[DataFrame, DataFrame]:
    """Answers from the cache (key, answer) or the client, and the cache's new rows; failures are not cached."""
    known = df.join(cache.select(key, "answer"), key).select(key, "answer", F.lit("cached").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    new = call(df.join(cache.select(key), key, "left_anti"), key, prompt, client, **options)
    return known.unionByName(new), new.where("status = 'ok'").select(key, "answer")


def mask_answer(answer: Column, original: Column) -> Column:
    """A masking answer, checked and put in order: struct<problem, has_leakage, sanitized_desc, replacements>.

    The answer is a JSON object of has_leakage, sanitized_desc and replacements (type, original). Types go by any of their
    names; repeated replacements are one, and those without a placeholder in the text go. An answer without leakage
    has the original text. ``problem`` says what is wrong first, and is null if nothing is; then the rest is null.
    """
    v = F.try_parse_json(json_in_answer(answer))

    def part(i: Column, name: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get(i, f"$.{name}", "string"), F.lit("")))

    names = F.create_map(*[F.lit(y) for kv in MASK_ALIASES.items() for y in kv])

    def read(fields: Column) -> Column:
        """Each field read once."""
        at = lambda name: F.try_element_at(fields, F.lit(name))
        kind = lambda name: F.schema_of_variant(at(name))
        items = F.transform(
            F.try_variant_get(at("replacements"), "$", "array<variant>"),
            lambda i: F.struct(F.schema_of_variant(i).startswith("OBJECT").alias("whole"), F.element_at(names, F.lower(part(i, "type"))).alias("type"), part(i, "original").alias("original")),
        )
        return F.struct(
            fields.isNull().alias("none"),
            F.array_except(F.array(*map(F.lit, ("has_leakage", "replacements", "sanitized_desc"))), F.map_keys(fields)).alias("missing"),
            (kind("has_leakage") != "BOOLEAN").alias("no_flag"),
            (kind("sanitized_desc") != "STRING").alias("no_text"),
            (~kind("replacements").startswith("ARRAY")).alias("no_list"),
            F.try_variant_get(at("has_leakage"), "$", "boolean").alias("flag"),
            F.trim(F.try_variant_get(at("sanitized_desc"), "$", "string")).alias("text"),
            items.alias("items"),
        )

    def judged(r: Column) -> Column:
        faults = F.transform(
            r["items"],
            lambda i: F.when(~i["whole"], "a replacement is no object").when(i["original"] == "", "a replacement has no original").when(i["type"].isNull(), "a replacement's type is unknown"),
        )
        rows = F.array_distinct(F.transform(r["items"], lambda i: F.struct(i["type"].alias("type"), i["original"].alias("original"))))
        rows = F.filter(rows, lambda i: F.contains(r["text"], F.concat(F.lit("<"), i["type"], F.lit(">"))))
        return F.struct(r.alias("r"), F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0)).alias("fault"), rows.alias("rows"))

    def told(j: Column) -> Column:
        r, rows, flag = j["r"], j["rows"], j["r"]["flag"]
        problem = (
            F.when(r["none"], "no JSON")
            .when(F.size(r["missing"]) > 0, F.concat(F.lit("missing keys: "), F.array_join(r["missing"], ", ")))
            .when(r["no_flag"], "has_leakage is no boolean")
            .when(flag & r["no_text"], "sanitized_desc is no text")
            .when(flag & (r["text"] == ""), "sanitized_desc is empty")
            .when(r["no_list"], "replacements is no list")
            .when(j["fault"].isNotNull(), j["fault"])
            .when(flag & (placeholders(r["text"]) == 0), "no placeholder")
            .when(flag & (F.size(rows) == 0), "no replacement is left")
        )
        return F.struct(j.alias("j"), problem.alias("problem"))

    def put(x: Column) -> Column:
        good, flag = x["problem"].isNull(), x["j"]["r"]["flag"]
        none = F.array().cast("array<struct<type:string,original:string>>")
        return F.struct(
            x["problem"].alias("problem"),
            F.when(good, flag).alias("has_leakage"),
            F.when(good, F.when(flag, x["j"]["r"]["text"]).otherwise(original)).alias("sanitized_desc"),
            F.when(good, F.when(flag, x["j"]["rows"]).otherwise(none)).alias("replacements"),
        )

    fields = let(v, lambda x: F.try_variant_get(x, "$", "map<string,variant>"))
    return let(let(let(let(fields, read), judged), told), put)


def mask_errors(answer: Column) -> Column:
    """Why a masking answer is no good, null if it is."""
    return mask_answer(answer, F.lit(""))["problem"]


def retry_prompt(prompt: Column, problem: Column) -> Column:
    """The prompt of another try: with what was wrong before, if anything was."""
    return F.when(problem.isNull(), prompt).otherwise(F.concat(prompt, F.lit("\n\nThe last answer was not valid: "), problem))


def needs_call(flag: Column, text: Column) -> Column:
    """Restating is due if there was leakage, or none is known of but the text has placeholders."""
    return F.coalesce(flag, F.coalesce(placeholders(text) > 0, F.lit(False)))


def rule_mask(text: Column) -> Column:
    """A deterministic stand-in for a masking model: symbols, files and versions become placeholders."""
    out = F.regexp_replace(text, r"\b[\w./-]+\.(?:cc|cpp|cxx|c|hpp|hh|hxx|h|mm|m|java|js|ts|py|go|rs)\b", "<FILE>")
    out = F.regexp_replace(out, r"\w+(?:::\w+)+(?:\(\))?", "<FUNC>")
    return F.regexp_replace(out, r"\b\d+(?:\.(?:x|\d+)){1,4}\b", "<SOFTWARE_VERSION>")


def masked(df: DataFrame, text: str) -> DataFrame:
    """Adds has_leakage and the masked text by the rules above."""
    return df.withColumn("has_leakage", maybe_leaks(F.col(text))).withColumn(f"{text}_masked", F.when(F.col("has_leakage"), rule_mask(F.col(text))).otherwise(F.col(text)))


def restated(c: Column) -> Column:
    """Placeholders in words."""
    out = c
    for mark, words in (("FILE", "a source file"), ("FUNC", "a function"), ("SOFTWARE_VERSION", "an affected version"), ("OS_VERSION", "a system version")):
        out = F.replace(out, F.lit(f"<{mark}>"), F.lit(words))
    return out


def two_stages(df: DataFrame, key: str, first: Column, second: Column, related: list[str]) -> DataFrame:
    """Stage 1 for all rows, stage 2 for those it calls related; the second verdict counts where there is one."""
    one = df.withColumn("stage1", first)
    two = one.where(F.col("stage1").isin(related)).select(key, second.alias("stage2"))
    return one.join(two, key, "left").withColumn("label", F.coalesce("stage2", "stage1"))


def empty_issue(description: Column, comments: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return blank(description) & ~F.coalesce(F.exists(comments, lambda x: ~blank(x)), F.lit(False))


def prompt(sections: list[tuple[str, Column]]) -> Column:
    """Filled sections with their headings, in order."""
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {h}\n"), c)) for h, c in sections]), lambda x: x.isNotNull()), "\n\n")


def transcript_predictions(transcripts: DataFrame, text: str, key: str = "vulnerable_functions") -> DataFrame:
    """The list under ``key`` of a transcript's last JSON object that has it, as ordered (file, sig); items without a name go."""
    item = "struct<file:string,function_name:string,func_name:string,name:string>"
    parsed = F.from_json(last_json(F.col(text), key), f"struct<`{key}`:array<{item}>>")[key]
    items = F.coalesce(parsed, F.array().cast(f"array<{item}>"))
    filled_ = lambda c: F.nullif(c, F.lit(""))
    norm = F.transform(items, lambda x: F.struct(F.coalesce(x["file"], F.lit("")).alias("file"), F.coalesce(filled_(x["function_name"]), filled_(x["func_name"]), filled_(x["name"])).alias("sig")))
    return transcripts.withColumn("predicted", F.filter(norm, lambda x: x["sig"].isNotNull()))


def mentions(messages: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Most mentioned match of a pattern by key, longer ones first among equals."""
    each = messages.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("m")).groupBy(key, "m").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.max_by(F.struct("m", "n"), F.struct("n", F.length("m").alias("l"), "m")).alias("b")).select(key, F.col("b.m").alias("mention"), F.col("b.n").alias("n"))


def forbidden(command: Column) -> Column:
    """Commands that look into a repository's history."""
    return F.coalesce(command.rlike(HISTORY_COMMAND), F.lit(False))
