"""Line dedup by a log-template tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import SPACE, free_name, materialize, shared_path

VARIABLE = "<*>"
# Lines of a leaf that elect leaders in one round, after the first.
AT_ONCE = 256
# A token with a digit in it, from its first character on: one step per character.
HAS_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def masked_line(line: Column) -> Column:
    """Tokens joined by one space, those with a digit as <*>; empty for a blank line."""
    spaced = F.when(F.rlike(line, F.lit(r"[\x09-\x0D]|\x20\x20")), F.regexp_replace(line, SPACE, " ")).otherwise(line)
    spaced = F.trim(spaced)
    return F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(spaced, HAS_DIGIT, VARIABLE)).otherwise(spaced)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _leaf(lines: DataFrame, depth: int) -> DataFrame:
    """The tree's path to each line's leaf: its number of tokens, then its leading tokens."""
    return lines.withColumn(
        "n", F.char_length("masked") - F.char_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    ).withColumn("lead", F.substring_index("masked", " ", depth))


def _alike(line: Column, leader: Column, n: Column, similarity: float) -> Column:
    """Whether a masked line of n tokens belongs to a leader's template; a leader belongs to its own."""
    same = F.zip_with(F.split(line, " "), F.split(leader, " "), lambda a, b: a == b)
    return (line == leader) | (F.size(F.filter(same, lambda x: x)) >= F.lit(float(similarity)) * n)


def _first_leader(lines: DataFrame) -> DataFrame:
    """n, lead, leaders: the line of each leaf that is in most documents."""
    most = F.struct((-F.col("docs")).alias("fewer"), "masked")
    return lines.groupBy("n", "lead").agg(F.array(F.min(most)["masked"]).alias("leaders"))


def _next_leaders(lines: DataFrame, similarity: float, at_once: int) -> DataFrame:
    """n, lead, leaders: those that the first `at_once` lines of each leaf elect among them, in order.

    A line is a leader unless it is like one before it, so these are the leaders that single
    elections would find, and no other leader comes before any of them.
    """
    along = Window.partitionBy("n", "lead").orderBy(F.col("docs").desc(), "masked")
    tops = lines.withColumn("at", F.row_number().over(along)).where(F.col("at") <= at_once)
    tops = tops.groupBy("n", "lead").agg(F.array_sort(F.collect_list(F.struct("at", "masked"))).alias("tops"))

    def elected(leaders: Column, line: Column) -> Column:
        led = F.exists(leaders, lambda leader: _alike(line, leader, F.col("n"), similarity))
        return F.when(led, leaders).otherwise(F.concat(leaders, F.array(line)))

    none = F.array().cast("array<string>")
    return tops.select("n", "lead", F.aggregate(F.col("tops.masked"), none, elected).alias("leaders"))


def _grouped(lines: DataFrame, min_docs: int, similarity: float, at_once: int = AT_ONCE) -> DataFrame:
    """masked, docs and first, the leader of each line, from masked, docs, n and lead.

    A round settles the lines that are like a leader, the others go on to the next: first one
    leader a leaf, which settles nearly all, then those among many lines at once. Lines of a leaf
    that together have fewer than `min_docs` documents left are no template and go.
    """
    spark, path = lines.sparkSession, shared_path(lines.sparkSession, "line-groups")
    leaders, rest, n = _first_leader(lines), lines, 0
    while True:
        met = rest.join(leaders, ["n", "lead"])
        own = F.filter("leaders", lambda leader: _alike(F.col("masked"), leader, F.col("n"), similarity))
        met = met.select("masked", "docs", "n", "lead", F.get(own, F.lit(0)).alias("first"))
        met.write.option("compression", "zstd").parquet(f"{path}/round={n}")
        rest = spark.read.schema(met.schema).parquet(f"{path}/round={n}").where("first is null").drop("first")
        left = rest.groupBy("n", "lead").agg(F.sum("docs").alias("left")).where(F.col("left") >= min_docs)
        rest = rest.join(left.drop("left"), ["n", "lead"])
        if rest.isEmpty():
            break
        leaders, n = _next_leaders(rest, similarity, at_once), n + 1
    return spark.read.schema(met.schema).parquet(path).where("first is not null").select("masked", "docs", "first")


def line_templates(
    docs: DataFrame, min_docs: int = 3, depth: int = 3, similarity: float = 0.7, text_col: str = "text"
) -> DataFrame:
    """One row per masked line whose template may recur: masked, first, template, docs, sure.

    A line goes down a tree of fixed depth: number of tokens, then `depth` leading tokens, tokens
    with digits counting as variable. In its leaf it is compared to the leaf's leader, the masked
    line in most documents (ties: the smallest). With at least `similarity` of its tokens equal
    to the leader's it belongs to the leader's template, and the tokens that differ are variable.
    The lines left elect a leader among them, and so on until every line has one; `first` names it.
    Templates whose lines have fewer than `min_docs` documents together are left out. `sure` are
    those with so many in one line; of the others it takes the documents to tell, which may hold
    several of their lines each.
    """
    distinct = F.array_distinct(F.transform(lines_of(F.col(text_col)), masked_line))
    lines = docs.select(F.explode(distinct).alias("masked")).where("masked <> ''")
    # One row per different line; copies meet in the map tasks before they are shuffled.
    counted = lines.groupBy("masked").agg(F.count("*").alias("docs"))
    counted = materialize(_leaf(counted, depth).select("masked", "docs", F.xxhash64("n", "lead").alias("leaf")), "line-counts")
    # Text moves once more, and only lines of leaves that can recur at all go on.
    live = counted.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs)
    live = materialize(live.select("leaf"), "leaves")
    counted = materialize(_leaf(counted.join(live, "leaf").drop("leaf"), depth), "leaf-lines")
    grouped = _grouped(counted, min_docs, similarity)
    pairs = F.zip_with(F.split("masked", " "), F.split("first", " "), lambda a, b: F.when(a == b, a).otherwise(VARIABLE))
    grouped = grouped.select("masked", "docs", "first", F.array_join(pairs, " ").alias("template"))
    totals = grouped.groupBy("first").agg(F.sum("docs").alias("most_docs"), F.max("docs").alias("in_one"))
    totals = totals.where(F.col("most_docs") >= min_docs).select("first", (F.col("in_one") >= min_docs).alias("sure"))
    return grouped.join(totals, "first").select("masked", "first", "template", "docs", "sure")


def find_recurring_lines(
    docs: DataFrame,
    min_docs: int = 3,
    depth: int = 3,
    similarity: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, uid, n_lines, dropped (the numbers, from 0, of recurring lines).

    Lines recur if their template (see `line_templates`) is in at least `min_docs` documents,
    whichever of its lines they hold. Blank lines never recur. Null text has one blank line, as empty text has. Rows that repeat a
    document count as documents each, and get the same answer. Other columns are not read.
    Without documents no rows come.
    """
    found = line_templates(docs, min_docs, depth, similarity, text_col)
    found = found.select(F.unhex(F.md5("masked")).alias("key"), F.unhex(F.md5("first")).alias("template"), "sure")
    found = materialize(found, "templates")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # What tells a document is made once, before its lines become rows.
    own = own.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), lines_of(F.col("text")).alias("lines"))
    own = own.select("doc_id", "uid", F.size("lines").alias("n_lines"), "lines")
    lines = own.select("doc_id", "uid", "n_lines", F.posexplode("lines").alias("line", "raw"))
    lines = lines.withColumn("key", F.unhex(F.md5(masked_line(F.col("raw")))))
    joined = lines.select("doc_id", "uid", "n_lines", "line", "key").join(found, "key", "left").drop("key")
    # The first line stands for its document, so that documents without recurring lines keep a row.
    kept = materialize(joined.where(F.col("template").isNotNull() | (F.col("line") == 0)), "template-lines")
    # Documents per template: rows that repeat a document repeat each of its lines as often.
    doubtful = kept.where(~F.col("sure")).groupBy("template", "uid", "line").agg(F.count("*").alias("copies"))
    doubtful = doubtful.groupBy("template", "uid").agg(F.max("copies").alias("copies"))
    met = doubtful.groupBy("template").agg(F.sum("copies").alias("docs")).where(F.col("docs") >= min_docs)
    met = met.select(F.col("template").alias("met"), F.lit(True).alias("passed"))
    kept = kept.join(met, F.col("template") == F.col("met"), "left")
    kept = kept.withColumn("recurs", F.coalesce("sure", F.lit(False)) | F.coalesce("passed", F.lit(False)))
    told = kept.groupBy("doc_id", "uid", "n_lines").agg(
        F.sum((F.col("line") == 0).cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("recurs"), F.col("line")))).alias("dropped"),
    )
    return told.select(
        "doc_id",
        "uid",
        F.col("n_lines").cast("long").alias("n_lines"),
        "dropped",
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs without their recurring lines; columns as they are, texts without such lines untouched.

    Null texts stay null, rows that repeat get the same answer, and no rows give no rows.
    """
    uid, dropped = free_name(docs.columns, "_line_uid"), free_name(docs.columns, "_line_dropped")
    found = find_recurring_lines(docs, id_col=id_col, text_col=text_col, **settings).where(F.size("dropped") > 0)
    found = found.select(F.col("uid").alias(uid), F.col("dropped").alias(dropped)).dropDuplicates([uid])
    kept = F.filter(lines_of(F.col(text_col)), lambda line, i: ~F.array_contains(dropped, i))
    text = F.when(F.col(uid).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    joined = docs.join(found, F.xxhash64(F.col(id_col), F.col(text_col)) == F.col(uid), "left")
    return joined.withColumn(text_col, text).select(*docs.columns)
