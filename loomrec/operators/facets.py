"""Completions to facets: strict JSON natively, everything else in one lenient Arrow-batched step."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.columns import draw, word_list

FACET = "struct<facet: string, confidence: double, supporting_neighbors: array<string>>"
FACETS = f"array<{FACET}>"
MAX_CHARS = 400

#: Names that completions use for the same fields.
LIST_KEYS = ("facets", "preference_facets", "facet_list", "preferences", "output")
TEXT_KEYS = ("facet", "text", "description", "preference", "facet_text")
SOURCE_KEYS = ("supporting_neighbors", "source_ids", "sources", "evidence", "neighbors")
QUOTES = str.maketrans("“”‘’", "\"\"''")


def node(raw: Column) -> Column:
    """User-7 or Item-7 from the forms that models write (u_7, [item 007]); null for anything else."""
    s = F.regexp_replace(raw, r"^[\s\[\](){}<>\"']+|[\s\[\](){}<>\"']+$", "")
    kind = F.lower(F.regexp_extract(s, r"(?i)^(user|item|u|i)[-_ ]+(\d+)$", 1))
    number = F.regexp_replace(F.regexp_extract(s, r"(?i)^(user|item|u|i)[-_ ]+(\d+)$", 2), "^0+(?=.)", "")
    return F.when(kind.isin("user", "u"), F.concat(F.lit("User-"), number)).when(kind.isin("item", "i"), F.concat(F.lit("Item-"), number))


def _node(raw) -> str | None:
    m = re.fullmatch(r"(user|item|u|i)[-_ ]+(\d+)", raw.strip(" \t\n[](){}<>\"'"), re.I) if isinstance(raw, str) else None
    return f"{'User' if m[1][0] in 'uU' else 'Item'}-{int(m[2])}" if m else None


def _confidence(raw) -> float:
    """A number from 0 to 1: numbers are clipped, texts may be percentages, anything else is 0.5."""
    share = isinstance(raw, str) and "%" in raw
    if isinstance(raw, str):
        digits = re.findall(r"-?(?:\d+\.?\d*|\.\d+)", raw)
        raw = float(digits[0]) if digits else None
    if not isinstance(raw, (int, float)) or raw != raw:
        return 0.5
    return min(1.0, max(0.0, raw / 100 if share else float(raw)))


def _facet(raw) -> dict | None:
    """One entry as a facet; None if it has no text."""
    if isinstance(raw, str):
        raw = {"facet": raw}
    if not isinstance(raw, dict):
        return None
    text = next((raw[k].strip() for k in TEXT_KEYS if isinstance(raw.get(k), str) and raw[k].strip()), None)
    if text is None:
        return None
    cited: list[str] = []
    for k in SOURCE_KEYS:
        v = raw.get(k)
        v = re.split("[,;]", v) if isinstance(v, str) else list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        cited = list(dict.fromkeys(filter(None, map(_node, v))))
        if cited:
            break
    return {"facet": text[:MAX_CHARS], "confidence": _confidence(raw.get("confidence", raw.get("score", 0.5))), "supporting_neighbors": cited}


def _entries(value) -> list | None:
    """The list of entries in a decoded value: itself, the first field that may hold one, or one facet by itself."""
    held = value
    if isinstance(value, dict):
        named = [value[k] for k in LIST_KEYS if isinstance(value.get(k), (list, dict, str))]
        held = named[0] if named else [value] if set(TEXT_KEYS) & set(value) else None
    match held:
        case list():
            return held
        case dict():
            return list(held.values())
        case str() if held is not value:
            return [held]
    return None


def _decoded(text: str, at: int):
    try:
        return json.JSONDecoder().raw_decode(text, at)
    except (ValueError, RecursionError):
        return None


def lenient(completion) -> tuple[list[dict], bool, bool, int, str | None]:
    """facets, valid, truncated, dropped, error. A value is decoded at the first opening bracket where that works and
    gives facets; a text whose outermost value never ends gives the whole facet objects within it."""
    if not isinstance(completion, str) or not completion.strip():
        return [], False, False, 0, "empty completion"
    text = completion.translate(QUOTES)
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    text = re.sub(r",\s*(?=[}\]])", "", fenced[1] if fenced else text)
    opens = [m.start() for m in re.finditer(r"[{\[]", text)]
    if not opens:
        return [], False, False, 0, "no JSON object found"
    best: tuple[list[dict], bool, bool, int, str | None] = ([], False, False, 0, "undecodable JSON")
    for form in (text, text.replace("'", '"')):
        loose, end, broken = [], -1, False
        for at in opens:
            if at < end:  # within a value that was read
                continue
            got = _decoded(form, at)
            if got is None:
                broken = True
                continue
            value, end = got
            entries = _entries(value)
            if not broken and entries is not None:
                facets = [f for f in map(_facet, entries) if f]
                if facets:
                    return facets, True, False, len(entries) - len(facets), None
                best = ([], False, False, len(entries), "no usable facets")
            elif isinstance(value, dict) and any(k in value for k in TEXT_KEYS):
                loose.append(value)
            elif not broken:
                best = (*best[:4], "no facet list in JSON")
        facets = [f for f in map(_facet, loose) if f]
        if facets:
            return facets, False, True, len(loose) - len(facets), "recovered from truncated JSON"
    return best


def parse_facets(completions: DataFrame, max_facets: int | None = 7, allowed: str | None = None) -> DataFrame:
    """completions (req_id, completion, and an array column `allowed` if named) -> req_id, facets, cited (with unknown
    ids), valid, truncated, dropped, error. Never fails on a row: null or undecodable text has no facets."""
    strict = F.from_json("completion", f"struct<facets: {FACETS}, _bad: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keep = ["req_id"] + ([allowed] if allowed else [])
    rows = completions.select(*keep, "completion", strict.alias("_s"))
    plain = F.expr("_s._bad is null and size(_s.facets) > 0 and forall(_s.facets, f -> f.facet is not null and trim(f.facet) <> '' and f.confidence is not null and f.confidence between 0 and 1 and f.supporting_neighbors is not null)")
    rows = rows.withColumn("_plain", F.coalesce(plain, F.lit(False)) & ~F.contains(F.coalesce("completion", F.lit("")), F.lit("```")))
    clean = F.transform(
        "_s.facets",
        lambda f: F.struct(
            F.substring(F.trim(f["facet"]), 1, MAX_CHARS).alias("facet"),
            f["confidence"].alias("confidence"),
            F.array_distinct(F.filter(F.transform(f["supporting_neighbors"], node), lambda n: n.isNotNull())).alias("supporting_neighbors"),
        ),
    )
    fast = rows.where("_plain").select(*keep, clean.alias("facets"), F.lit(True).alias("valid"), F.lit(False).alias("truncated"), F.lit(0).alias("dropped"), F.lit(None).cast("string").alias("error"))

    def salvage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [lenient(c) for c in frame["completion"]]
            yield frame.drop(columns="completion").assign(**{n: [f[i] for f in found] for i, n in enumerate(("facets", "valid", "truncated", "dropped", "error"))})

    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in keep) + f", facets {FACETS}, valid boolean, truncated boolean, dropped int, error string"
    slow = rows.where("not _plain").select(*keep, "completion").mapInPandas(salvage, ddl)
    out = fast.unionByName(slow)
    if max_facets is not None:
        out = out.withColumn("facets", F.slice("facets", 1, max_facets))
    out = out.withColumn("cited", F.array_distinct(F.flatten(F.transform("facets", lambda f: f["supporting_neighbors"]))))
    if allowed:
        known = lambda f: F.struct(f["facet"].alias("facet"), f["confidence"].alias("confidence"), F.filter(f["supporting_neighbors"], lambda n: F.array_contains(allowed, n)).alias("supporting_neighbors"))
        out = out.withColumn("facets", F.transform("facets", known))
    return out.select("req_id", "facets", "cited", "valid", "truncated", "dropped", "error")


def answered(requests: DataFrame, parsed: DataFrame) -> DataFrame:
    """requests with facets and failed: a request without a readable answer has no facets."""
    out = requests.join(parsed.select("req_id", "facets"), "req_id", "left")
    return out.withColumn("failed", F.col("facets").isNull() | (F.size("facets") == 0)).withColumn("facets", F.coalesce("facets", F.array().cast(FACETS)))


def facet_vectors(facets: DataFrame, width: int = 64) -> DataFrame:
    """facets (user_id, facet, confidence) -> user_id, dim, value: non-zero entries of the user's vector.

    Each facet is a bag of hashed words of length 1, weighted by confidence; the mean has length 1 again. A facet that a
    user has several times counts as often."""
    rows = facets.groupBy("user_id", "facet", F.coalesce("confidence", F.lit(0.5)).alias("_c")).agg(F.count("*").alias("_times"))
    # Words carry a digest of their facet and not its text, which would make a shuffle of the square of a text's length.
    rows = rows.select("user_id", "facet", (F.col("_c") * F.col("_times")).alias("confidence"), F.struct(F.unhex(F.sha2("facet", 256)).alias("facet"), "_c").alias("_id"))
    words = rows.select("user_id", "_id", "confidence", F.explode(word_list(F.col("facet"))).alias("word"))
    dims = words.groupBy("user_id", "_id", "confidence", draw(F.md5("word"), F.lit(width)).alias("dim")).agg(F.count("*").alias("n"))
    held = dims.groupBy("user_id", "_id", "confidence").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.collect_list(F.struct("dim", "n")).alias("held"))  # width at most
    mean = held.select("user_id", "confidence", "norm", F.inline("held")).groupBy("user_id", "dim").agg(F.sum(F.col("n") / F.col("norm") * F.col("confidence")).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("user_id")))
    return mean.select("user_id", "dim", F.coalesce(F.try_divide("v", length), F.lit(0.0)).alias("value"))


def dense_vectors(users: DataFrame, entries: DataFrame, width: int = 64) -> DataFrame:
    """user_id, vector: all dimensions, zeros for users without facets."""
    held = entries.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
    return users.select("user_id").distinct().join(held, "user_id", "left").select("user_id", at.alias("vector"))
