"""Line dedup by a fixed-depth tree of line templates.

A line is split at white space; tokens with a digit, an at sign or a scheme are variable fields and read ``<*>``. The
tree's levels are the number of tokens and the first ``depth`` of them; what shares that path is a leaf. Templates
are found in three ways, all over all lines:

* a masked line that occurs in at least ``min_docs`` different texts, or in two if it has ``long_tokens`` fixed words;
* a leaf of at least ``min_docs`` different texts whose lines agree in at least ``similarity`` of their positions after the
  first ``depth``, the others becoming variable fields as well;
* a group within a leaf: tokens rarer at their position than a threshold become variable fields, and the lines that then
  read the same, with a share of ``similarity`` of fixed positions after the first ``depth``, are one group. Thresholds
  are ``min_docs`` and the shares ``LEVELS`` of the leaf, so groups of any size are found beside whatever else is there.

Lines of a recurring template are dropped from every document; copies of one text count as one.

Counting goes over (leaf, line, text) combinations, combined before the shuffle, so a line that stands in a third of
all documents is one row per text until it is a number. Only leaves with enough texts are compared position by position,
on distinct lines and hashed tokens. Until then a line is one string of masked tokens with single blanks between them:
equal strings are equal tokens, blanks count tokens, and no line is split into tokens that is not compared.

Edge cases: a null text stays null with 0 lines; lines of fewer than ``min_tokens`` tokens are never dropped; an empty
text has one (empty) line; rows that repeat are cleaned alike; an empty table gives an empty result; other
columns stay as they are, except that ``n_lines``, ``n_dropped`` and the text are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import shield
from tracewarden.session import cut_lineage

#: Shapes of variable fields.
VARIABLE = r"(?<!\S)\S*?(?:[0-9@]|://)\S*"
#: Lines without any of these hold only words and blanks; one class of single characters is the quickest pattern.
SUSPECT = "[0123456789@:\t\r\f\x0b]"
#: Shares of a leaf's lines below which a token counts as a variable field.
LEVELS = (0.0, 0.02, 0.1, 0.4)
#: Leaves to compare position by position are broadcast up to this number (8 bytes each), and joined beyond it.
BROADCAST_LEAVES = 1_000_000


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _masked(text: Column) -> Column:
    """The lines of a text, of each its tokens with variable fields masked and single blanks between them, and their number.

    Each step is a ``transform`` of its own below the generator, so that no filter on the result works it out again.
    """
    words = F.transform(lines(text), lambda x: F.when(
        x.rlike(SUSPECT), F.regexp_replace(F.translate(x, "\t\r\f\x0b", "    "), VARIABLE, "<*>")
    ).otherwise(x))
    single = F.transform(words, lambda x: F.trim(F.when(x.contains("  "), F.regexp_replace(x, " +", " ")).otherwise(x)))
    blanks = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    return F.transform(single, lambda x: F.struct(x.alias("masked"), F.when(x == "", 0).otherwise(blanks(x) + 1).alias("size")))


def _parsed(docs: DataFrame, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """(text_hash, number, leaf, line, words, size, masked) of the lines long enough; words counts the fixed tokens."""
    text = F.col(f"`{text_col}`")
    exploded = docs.select(F.xxhash64(text).alias("text_hash"), F.posexplode(_masked(text)).alias("number", "of"))
    masked, size = F.col("of.masked"), F.col("of.size")
    path = F.xxhash64(size, F.substring_index(masked, " ", depth))
    fixed = F.size(F.array_remove(F.split(masked, " "), "<*>"))
    words = F.when(masked.contains("<*>"), fixed).otherwise(size)
    return exploded.filter(size >= min_tokens).select(
        "text_hash", "number", path.alias("leaf"), F.xxhash64(masked).alias("line"), words.alias("words"), size.alias("size"),
        masked.alias("masked"),
    )


def recurring(
    parsed: DataFrame, keys: DataFrame, depth: int, min_docs: int, similarity: float, long_tokens: int
) -> tuple[DataFrame, DataFrame]:
    """Masked lines (leaf, line) that are templates, and lines of generalised ones (leaf, line, template). ``keys`` is
    ``parsed`` without the lines themselves."""
    once = cut_lineage(keys.groupBy("leaf", "line", "text_hash").agg(F.max("words").alias("words")))
    per_line = cut_lineage(once.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("texts"), F.max("words").alias("words")))
    needed = F.when(F.col("words") >= long_tokens, min(2, min_docs)).otherwise(min_docs)
    fixed = per_line.filter(F.col("texts") >= needed).select("leaf", "line")
    # texts of a leaf are counted once each, whatever number of its lines they hold
    likely = per_line.groupBy("leaf").agg(F.count(F.lit(1)).alias("variants"), F.sum("texts").alias("texts"))
    likely = likely.filter((F.col("variants") > 1) & (F.col("texts") >= min_docs)).select("leaf", "texts")
    pairs = once.join(likely.select("leaf"), "leaf", "left_semi").select("leaf", "text_hash").distinct()
    enough = pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("own")).filter(F.col("own") >= min_docs).select("leaf")
    open_leaves = cut_lineage(likely.join(enough, "leaf", "left_semi"))
    if open_leaves.count() <= BROADCAST_LEAVES:
        open_leaves = F.broadcast(open_leaves)
    hashed = F.transform(F.slice(F.split("masked", " "), depth + 1, 1 << 30), lambda t: F.xxhash64(t))
    shapes = parsed.filter(F.col("size") > depth).join(open_leaves.select("leaf"), "leaf", "left_semi").select("leaf", "line", "masked")
    shapes = shapes.groupBy("leaf", "line").agg(F.first("masked").alias("masked")).select("leaf", "line", hashed.alias("rest"))
    shapes = cut_lineage(shapes.join(per_line.select("leaf", "line", "texts"), ["leaf", "line"]))
    cells = shapes.select("leaf", "line", "texts", F.posexplode("rest").alias("position", "token"))
    counts = cut_lineage(
        cells.groupBy("leaf", "position", "token").agg(F.sum("texts").alias("n"), F.count(F.lit(1)).alias("variants"))
    )
    agreed = counts.groupBy("leaf", "position").agg((F.count(F.lit(1)) == 1).alias("same"))
    whole = agreed.groupBy("leaf").agg(F.avg(F.col("same").cast("int")).alias("share")).filter(F.col("share") >= similarity)
    general = per_line.join(whole.select("leaf"), "leaf", "left_semi").select("leaf", "line", F.col("leaf").alias("template"))

    frequent = counts.filter(F.col("n") >= min_docs).select("leaf", "position", "token", "n")
    known = cells.join(frequent, ["leaf", "position", "token"]).groupBy("leaf", "line").agg(
        F.array_sort(F.collect_list(F.struct("position", "token", "n"))).alias("known")
    )
    sized = known.join(shapes.select("leaf", "line", F.size("rest").alias("size")), ["leaf", "line"]).join(open_leaves, "leaf")
    sized = sized.filter(F.size("known") >= similarity * F.col("size"))
    levels = sized.select("leaf", "line", "size", "known", "texts", F.explode(F.array(*map(F.lit, LEVELS))).alias("level"))
    fixed_at = F.transform(
        F.filter("known", lambda x: x["n"] >= F.col("level") * F.col("texts")), lambda x: F.struct(x["position"], x["token"])
    )
    grouped = levels.withColumn("fixed_at", fixed_at).filter(F.size("fixed_at") >= similarity * F.col("size"))
    grouped = cut_lineage(grouped.select("leaf", "line", F.xxhash64("leaf", "fixed_at").alias("template")).distinct())
    found = grouped.groupBy("template").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("template")
    texts = once.join(grouped.join(found, "template", "left_semi"), ["leaf", "line"]).select("template", "text_hash").distinct()
    often = texts.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    return fixed, general.unionByName(grouped.join(often.select("template"), "template", "left_semi").select("leaf", "line", "template"))


def templates(docs: DataFrame, text_col: str = "text", depth: int = 3, min_tokens: int = 4, min_docs: int = 5, similarity: float = 0.7, long_tokens: int = 50) -> DataFrame:
    """(template, variants): the recurring templates as text, for reading."""
    parsed = _parsed(docs, text_col, depth, min_tokens)
    keys = cut_lineage(parsed.drop("size", "masked"))
    fixed, general = recurring(parsed, keys, depth, min_docs, similarity, long_tokens)
    shown = parsed.join(fixed, ["leaf", "line"], "left_semi").groupBy("leaf", "line").agg(F.first("masked").alias("template"))
    exact = shown.select("template", F.lit(1).cast("long").alias("variants"))
    positions = parsed.join(general, ["leaf", "line"]).select("template", "line", F.posexplode(F.split("masked", " ")).alias("position", "token"))
    merged = positions.groupBy("template", "position").agg(
        F.when(F.min("token") == F.max("token"), F.min("token")).otherwise("<*>").alias("token"), F.count_distinct("line").alias("variants")
    )
    whole = merged.groupBy(F.col("template").alias("of")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda x: x["token"]), " ").alias("template"),
        F.max("variants").alias("variants"),
    )
    return exact.unionByName(whole.drop("of"))


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", depth: int = 3, min_tokens: int = 4, min_docs: int = 5, similarity: float = 0.7,
    long_tokens: int = 50,
) -> DataFrame:
    """The documents without the lines of recurring templates, with ``n_lines`` and ``n_dropped``."""
    rows, own, kept = shield(docs, ("n_lines", "n_dropped"))
    parsed = _parsed(docs, text_col, depth, min_tokens)
    keys = cut_lineage(parsed.drop("size", "masked"))
    fixed, general = recurring(parsed, keys, depth, min_docs, similarity, long_tokens)
    gone = cut_lineage(fixed.unionByName(general.select("leaf", "line")).distinct())
    dropped = (
        keys.join(gone, ["leaf", "line"], "left_semi").select("text_hash", "number")
        .groupBy(F.col("text_hash").alias("_hash")).agg(F.collect_set("number").alias("_dropped"))
    )
    text = own[text_col]
    joined = rows.select("*", F.xxhash64(text).alias("_own")).join(dropped, F.col("_own") == F.col("_hash"), "left")
    gone = F.coalesce(F.col("_dropped"), F.array().cast("array<int>"))
    clean = F.array_join(F.filter(lines(text), lambda _, i: ~F.array_contains(gone, i)), "\n")
    cleaned = F.when(text.isNotNull() & (F.size(gone) > 0), clean).otherwise(text)
    return joined.select(
        *[(cleaned if c == text_col else own[c]).alias(c) for c in kept],
        F.when(text.isNull(), 0).otherwise(F.size(lines(text))).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )
