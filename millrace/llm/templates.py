"""Line deduplication by a fixed-depth template tree, in DataFrame operations only.

A line's tokens go down a tree of fixed depth: the number of tokens, then the leading tokens, each with a digit read as a wildcard. In a
leaf, a place that branches into more than `max_branch` tokens is a wildcard too, as long as enough of the line stays constant. Lines
that read the same then are one template; a template that occurs in at least `min_docs` documents is dropped from all but the first of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, staged, unused

DEPTH, MAX_BRANCH, MIN_DOCS, MIN_CONSTANT = 3, 4, 5, 0.6
#: White space within a line, and a token that holds a digit.
BLANK, DIGITS = "[ \\t\\r\\f\\x0b]+", "[^ 0-9]*[0-9][^ ]*"


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """row, doc_id, pos, leaf, masked of every line that isn't blank."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    odd = F.col("line").rlike("[\\t\\r\\f\\x0b]|  ")  # few lines need the replacements, which visit each blank and letter
    plain = lines.withColumn("line", F.trim(F.when(odd, F.regexp_replace("line", BLANK, " ")).otherwise(F.col("line"))))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", DIGITS, "<*>")).otherwise(F.col("line"))
    masked = plain.select("row", "doc_id", "pos", masked.alias("masked")).where("masked != ''")
    head = F.substring_index("masked", " ", depth)
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return masked.withColumn("leaf", F.xxhash64(tokens, head))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, max_branch: int = MAX_BRANCH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """The rows and columns of `documents`, with the text less its dropped lines, and n_lines, n_dropped.

    Lines end in a line feed; blank ones stay. A text that loses all lines is empty; a null text stays null with no lines. A template counts
    documents, not rows: rows that repeat a doc_id are one document, and the smallest doc_id keeps its lines. Rows without an id count as
    no document and lose lines that others have. Columns named like the two new ones are replaced. An empty table gives no rows.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    docs = documents.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = _lines(docs.where("text is not null"), depth)
    held = lines.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("doc_id").alias("docs")).where(F.col("docs") >= min_docs)
    leaves = staged(few(held.select("leaf")), "leaves")
    again = staged(lines.join(leaves, "leaf", "left_semi"), "recurring")
    places = again.select("leaf", "masked").distinct().select("leaf", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    branches = places.distinct().groupBy("leaf", "at").agg(F.count("*").alias("n")).where((F.col("n") > max_branch) & (F.col("at") >= depth))
    wild = staged(few(branches.groupBy("leaf").agg(F.collect_list("at").alias("wild"))), "wild")
    tokens = F.split("masked", " ")
    general = F.transform(tokens, lambda t, i: F.when(F.array_contains("wild", i), F.lit("<*>")).otherwise(t))
    constant = F.size(F.filter(general, lambda t: t != "<*>"))
    template = F.when(F.col("wild").isNotNull() & (constant >= min_constant * F.size(tokens)), F.array_join(general, " ")).otherwise(F.col("masked"))
    read = again.join(wild, "leaf", "left").select("row", "doc_id", "pos", F.xxhash64("leaf", template).alias("template"))
    known = staged(read, "templates")
    many = known.select("template", "doc_id").distinct().groupBy("template").agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    drops = known.join(staged(few(many.select("template", "first")), "dropped"), "template").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    per_row = staged(few(drops.select("row", "pos").distinct().groupBy("row").agg(F.collect_list("pos").alias("drops"))), "drops")
    given, (key, cut) = documents, (unused(documents, "__row"), unused(documents, "__drops"))
    joined = given.withColumn(key, row).join(per_row.withColumnsRenamed({"row": key, "drops": cut}).hint("merge"), key, "left")
    split = F.split(F.col(text_col), "\n")
    left = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s) - 1), cut)  # noqa: E731  hashed, so a text may lose many lines
    rest = F.transform(F.array(split), lambda s: F.array_join(F.transform(left(s), lambda i: F.get(s, i)), "\n"))[0]  # one array, so that a text is split once and not once a line
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(rest)
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)), "n_dropped": F.coalesce(F.size(cut), F.lit(0))}
    keep = [c for c in documents.columns if c not in counts and c != text_col]
    return joined.select(*[text.alias(text_col) if c == text_col else F.col(c) for c in documents.columns if c in keep or c == text_col], *(v.alias(n) for n, v in counts.items()))
