"""Text contexts within a token budget, and request tables for the model steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.columns import node_id, three_places, tokens

NONE = "(none available)"


def ordered_text(rows: DataFrame, key: str, order: Column, text: Column, separator: str) -> DataFrame:
    """key, text: the rows' texts joined in an order."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("h"))
    return held.select(key, F.array_join(F.transform("h", lambda x: x["t"]), separator).alias("text"))


def recent_titles(edges: DataFrame, items: DataFrame, last: int = 3) -> DataFrame:
    """user_id, recent: titles (40 characters) of the last train items that have metadata."""
    late = edges.where(F.col("pos") >= F.col("n_train") - last).join(items.select("item_id", "title"), "item_id").where("title is not null")
    return ordered_text(late, "user_id", F.col("pos"), F.substring("title", 1, 40), ", ").withColumnRenamed("text", "recent")


def snippets(chosen: DataFrame, items: DataFrame, recent: DataFrame) -> DataFrame:
    """chosen with node and snippet, at most 200 characters."""
    about = items.select(F.lit("item").alias("nb_type"), F.col("item_id").alias("nb_id"), F.coalesce("title", F.concat(F.lit("Item-"), "item_id")).alias("_title"), F.coalesce("description", F.lit("")).alias("_about"))
    late = recent.select(F.lit("user").alias("nb_type"), F.col("user_id").alias("nb_id"), "recent")
    rows = chosen.join(about, ["nb_type", "nb_id"], "left").join(late, ["nb_type", "nb_id"], "left")
    node = F.concat(F.lit("["), node_id(F.col("nb_type"), F.col("nb_id")), F.lit("]"))
    about = F.when(F.length("_about") > 0, F.concat(F.lit(" | "), F.substring("_about", 1, 120))).otherwise("")
    item = F.concat(node, F.when(F.col("_title").isNotNull(), F.concat(F.lit(" "), F.substring("_title", 1, 80), about)).otherwise(""), F.lit(" (score="), three_places(F.col("score")), F.lit(")"))
    user = F.concat(node, F.lit(" (overlap_score="), three_places(F.col("score")), F.lit(")"), F.when(F.length("recent") > 0, F.concat(F.lit(" - Recent: "), "recent")).otherwise(""))
    text = F.substring(F.when(F.col("nb_type") == "item", item).otherwise(user), 1, 200)
    return rows.withColumn("node", node_id(F.col("nb_type"), F.col("nb_id"))).withColumn("snippet", text).drop("_title", "_about", "recent")


def budget(tau: int = 1800, candidates: bool = True, memory: bool = True) -> int:
    return tau - 300 * candidates - 200 * memory - 600


def packed(with_snippets: DataFrame, limit: int) -> DataFrame:
    """The rows whose running tokens, best score first, stay within the limit; n_tokens and place are added."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "ord")
    rows = with_snippets.withColumn("n_tokens", tokens(F.col("snippet")))
    rows = rows.withColumn("_sum", F.sum("n_tokens").over(order)).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("_sum") <= limit).drop("_sum")


def context_text(users: DataFrame, packed_rows: DataFrame, candidates: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """user_id, context, n_neighbors, n_tokens for each of users (user_id, memory)."""
    line = F.concat(F.col("place").cast("string"), F.lit(". "), "snippet")
    held = packed_rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("h"))
    out = users.join(held.select("user_id", F.array_join(F.transform("h", lambda x: x["line"]), "\n").alias("nb"), F.size("h").cast("long").alias("n")), "user_id", "left")
    memory = F.coalesce(F.nullif(F.trim("memory"), F.lit("")), F.lit("No memory yet."))
    parts = [F.concat(F.lit("User memory: "), F.substring(memory, 1, 200)), F.concat(F.lit("Neighbors:\n"), F.coalesce("nb", F.lit(NONE)))]
    if candidates is not None:
        titled = candidates.where("pos < 10").join(items.select("item_id", "title"), "item_id", "left")
        one = F.concat((F.col("pos") + 1).cast("string"), F.lit(". [Item-"), F.col("item_id").cast("string"), F.lit("] "), F.substring(F.coalesce("title", F.lit("N/A")), 1, 60))
        out = out.join(ordered_text(titled, "user_id", F.col("pos"), one, "\n").withColumnRenamed("text", "cand"), "user_id", "left")
        parts.append(F.concat(F.lit("Candidates:\n"), F.coalesce("cand", F.lit(NONE))))
    out = out.withColumn("context", F.concat_ws("\n\n", *parts))
    return out.select("user_id", "context", F.coalesce("n", F.lit(0)).alias("n_neighbors"), tokens(F.col("context")).alias("n_tokens"))


def parsed_snippets(texts: DataFrame) -> DataFrame:
    """user_id, snippets: node id -> the rest of its line, from numbered lines '1. [Item-5] ...'."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"^\d+\. \[(Item|User)-\d+\]"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\[((?:Item|User)-\d+)\]", 1).alias("k"), F.regexp_replace(x, r"^\d+\. \[(?:Item|User)-\d+\] ?", "").alias("v")))
    held = texts.select("user_id", F.filter(pairs, lambda p: p["k"] != "").alias("_p"))
    # Of several lines of a node the last counts.
    last = F.filter("_p", lambda p, i: ~F.exists(F.slice("_p", i + 2, F.size("_p")), lambda q: q["k"] == p["k"]))
    return held.select("user_id", F.map_from_entries(last).alias("snippets"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter(pos: Column) -> Column:
    """A to Z for places 0 to 25, AA to ZZ for the next 676."""
    one = lambda n: F.substring(F.lit(LETTERS), (n + 1).cast("int"), F.lit(1))
    return F.when(pos < 26, one(pos)).otherwise(F.concat(one(F.floor(pos / 26) - 1), one(pos % 26)))


def choice_prompt(requests: DataFrame) -> DataFrame:
    """requests (req_id, pos, title, memory, facets array<string>, instruction) -> req_id, prompt with a letter for each candidate."""
    about = F.when(F.length("memory") > 0, F.concat(F.lit(" - "), F.substring("memory", 1, 150))).otherwise("")
    line = F.concat(letter(F.col("pos")), F.lit(". "), "title", about)
    listed = ordered_text(requests, "req_id", F.col("pos"), line, "\n")
    head = requests.groupBy("req_id").agg(F.first("instruction", True).alias("instruction"), F.first("facets", True).alias("facets"))
    ask = F.when(F.length("instruction") > 0, F.concat(F.lit("Request: "), "instruction", F.lit("\n"))).otherwise("")
    known = F.when(F.size("facets") > 0, F.concat(F.lit("Preferences:\n"), F.array_join(F.transform("facets", lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("\n"))).otherwise("")
    return listed.join(head, "req_id").select("req_id", F.concat(F.coalesce(ask, F.lit("")), F.coalesce(known, F.lit("")), F.lit("Candidates:\n"), "text", F.lit("\nAnswer with one letter: ")).alias("prompt"))


def retrieve_request(contexts: DataFrame, n_facets: int = 7) -> DataFrame:
    """user_id, request for the facet step, from context_text's rows."""
    ask = F.lit(f"Summarise what this user wants as at most {n_facets} facets with confidence and supporting neighbours, as JSON.\n\n")
    return contexts.select("user_id", F.concat(ask, "context").alias("request"))


def policy_prompt(states: DataFrame) -> DataFrame:
    """user_id, prompt: memory and neighbours only, no candidates."""
    memory = F.coalesce(F.nullif(F.trim("user_memory"), F.lit("")), F.lit("(no memory)"))
    return states.select("user_id", F.concat(F.lit("Memory of the user:\n"), memory, F.lit("\n\nNeighbours:\n"), F.coalesce("neighbors_text", F.lit(NONE)), F.lit("\n\nWrite the facets as JSON.")).alias("prompt"))


def write_request(rows: DataFrame, facets: DataFrame, listed: DataFrame, fanout: int = 5) -> DataFrame:
    """user_id, request for the memory step: rows (user_id, user_memory, item_memory), at most five facets (user_id,
    nth, facet) and at most fanout neighbours (user_id, place, node, memory); the cap limits what is listed only."""
    five = ordered_text(facets.where("nth <= 5"), "user_id", F.col("nth"), F.concat(F.lit("- "), "facet"), "\n").withColumnRenamed("text", "five")
    blank = F.lower(F.trim("memory"))
    memory = F.when(blank.isNull() | blank.isin("", "nan", "[nan]", "['']"), "(No memory)").otherwise(F.substring("memory", 1, 150))
    near = ordered_text(listed.where(F.col("place") <= fanout), "user_id", F.col("place"), F.concat("node", F.lit(": "), memory), "\n").withColumnRenamed("text", "near")
    out = rows.join(five, "user_id", "left").join(near, "user_id", "left")
    part = lambda name, c: F.concat(F.lit(f"{name}:\n"), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(NONE)))
    return out.select("user_id", F.concat_ws("\n\n", part("Facets", "five"), part("User memory", "user_memory"), part("Item memory", "item_memory"), part("Neighbours", "near")).alias("request"))


def rerank_request(candidates: DataFrame, facets: DataFrame | None = None) -> DataFrame:
    """user_id, request: candidates (user_id, pos, item_id, title, description, tags, memory), with memories and at most
    ten facets (user_id, nth, facet), or without facets given, descriptions and at most five tags."""
    if facets is None:
        about = F.concat(F.lit(" | "), F.substring(F.coalesce("description", F.lit("")), 1, 200), F.lit(" | "), F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5), ", "))
    else:
        about = F.when(F.length("memory") > 0, F.concat(F.lit(" | "), F.substring("memory", 1, 150))).otherwise("")
    line = F.concat(F.lit("[Item-"), F.col("item_id").cast("string"), F.lit("] "), F.coalesce("title", F.lit("N/A")), about)
    out = ordered_text(candidates, "user_id", F.col("pos"), line, "\n")
    if facets is None:
        return out.withColumnRenamed("text", "request")
    ten = ordered_text(facets.where("nth <= 10"), "user_id", F.col("nth"), F.concat(F.lit("- "), "facet"), "\n").withColumnRenamed("text", "ten")
    head = F.when(F.length("ten") > 0, F.concat(F.lit("Facets:\n"), "ten", F.lit("\n"))).otherwise("")
    return out.join(ten, "user_id", "left").select("user_id", F.concat(F.coalesce(head, F.lit("")), "text").alias("request"))


def collaborative_summary(facets: DataFrame) -> DataFrame:
    """user_id, summary: five facets, cut to 500 characters."""
    text = ordered_text(facets.where("nth <= 5"), "user_id", F.col("nth"), F.col("facet"), "; ")
    return text.select("user_id", F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text")).alias("summary"))


def candidate_explanations(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """candidates (user_id, item_id) with explanation, from notes (user_id, item_id, nth, fit, rationale): the first note of
    a candidate, or that it comes from collaborative signals."""
    first = notes.groupBy("user_id", "item_id").agg(F.min_by(F.struct("fit", "rationale"), "nth").alias("_n"))
    told = F.format_string("Item %d (fit: %.2f): %s", F.col("item_id"), F.coalesce(F.col("_n.fit"), F.lit(0.0)), F.coalesce(F.col("_n.rationale"), F.lit("")))
    none = F.format_string("Item %d is recommended based on collaborative signals.", F.col("item_id"))
    return candidates.join(first, ["user_id", "item_id"], "left").withColumn("explanation", F.when(F.col("_n").isNull(), none).otherwise(told)).drop("_n")


def pluggable(requests: DataFrame, step, schema: str) -> DataFrame:
    """Run a batch model step: a callable from an iterator of pandas frames to an iterator of frames of the schema."""
    return requests.mapInPandas(step, schema)
