"""Which marker texts turn up in which capture, and whether secrets leak."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most characters of the piece that a text is looked up by, and of the head of a piece that is tried first; bytes of
# texts that go to every task at once.
GRAM, HEAD, MARKER_BYTES = 16, 4, 64 << 20


def coverage_matrix(
    lines: DataFrame, markers: dict[str, str], sources: list[str], text: str = "text", source: str = "source"
) -> DataFrame:
    """Markers by sources: `YES` where the marker's text occurs in a line of the source, else `no`.

    `markers` maps ids to the texts to look for. One pass with partial aggregation per source;
    the grid itself has a row per marker and a column per source.
    """
    seen = lines.where(F.col(source).isin(sources)).groupBy(source).agg(
        *[F.bool_or(F.col(text).contains(marker)).alias(f"_{i}") for i, marker in enumerate(markers.values())]
    )
    # `seen` has a row per source at most; folding it to one row keeps markers and sources that
    # have no line at all in the grid.
    flags = [
        F.bool_or((F.col(source) == name) & F.col(f"_{i}")).alias(f"_{i}_{j}")
        for i in range(len(markers))
        for j, name in enumerate(sources)
    ]

    def cell(i: int, j: int):
        return F.when(F.coalesce(f"_{i}_{j}", F.lit(False)), "YES").otherwise("no").alias(sources[j])

    rows = [
        F.struct(F.lit(marker).alias("marker"), *[cell(i, j) for j in range(len(sources))])
        for i, marker in enumerate(markers)
    ]
    return seen.agg(*flags).select(F.inline(F.array(*rows)))


def redaction_check(
    lines: DataFrame, markers: dict[str, str], secret: str, text: str = "text", source: str = "source"
) -> DataFrame:
    """Per source and marker: is a marked line present, and does any of them show the secret."""
    checks = []
    for i, marker in enumerate(markers.values()):
        marked = F.col(text).contains(marker)
        checks += [
            F.coalesce(F.bool_or(marked), F.lit(False)).alias(f"_present{i}"),
            F.coalesce(F.bool_or(marked & F.col(text).contains(secret)), F.lit(False)).alias(f"_leaked{i}"),
        ]
    seen = lines.groupBy(source).agg(*checks)
    rows = [
        F.struct(
            F.lit(name).alias("marker"),
            F.col(f"_present{i}").alias("present"),
            F.col(f"_leaked{i}").alias("leaked"),
        )
        for i, name in enumerate(markers)
    ]
    return seen.select(source, F.inline(F.array(*rows)))


def _grams(text: Column, n: int) -> Column:
    """All pieces of n characters of a text, wherever they begin."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def marker_keys(markers: DataFrame) -> DataFrame:
    """sought, key: every different text once, and the piece of it that it is looked up by.

    A text of up to GRAM characters is its own key, so what meets it is a find. Of the pieces of a
    longer one it is the one that the fewest texts share. Null texts occur nowhere.
    """
    texts = markers.where(F.col("sought").isNotNull()).select("sought").distinct()
    whole = texts.where(F.char_length("sought") <= GRAM).withColumn("key", F.col("sought"))
    longer = texts.where(F.char_length("sought") > GRAM)
    pieces = longer.withColumn("key", F.explode(F.array_distinct(_grams(F.col("sought"), GRAM))))
    shared = pieces.groupBy("key").agg(F.count("*").alias("_sharing"))
    rarest = F.min_by("key", F.struct("_sharing", "key")).alias("key")
    return whole.unionByName(pieces.join(shared, "key").groupBy("sought").agg(rarest))


def _in_parts(keys: DataFrame, total: int) -> list[DataFrame]:
    """The texts in parts of about MARKER_BYTES, one part unless there are very many."""
    n = max(1, -(-total // MARKER_BYTES))
    return [keys.where(F.pmod(F.xxhash64("sought"), F.lit(n)) == k) for k in range(n)] if n > 1 else [keys]


def find_markers(
    lines: DataFrame, markers: DataFrame, text: str = "text", source: str = "source", secret: str | None = None
) -> DataFrame:
    """source, marker, n_lines, leaked: which markers of a table occur in lines of which source.

    `markers` has `marker` and `sought`, the text to look for. A line is taken apart into windows
    of a few characters. Where a window begins as some keys do, its pieces of their lengths are
    made; those that are a text's key meet it in a join, and only there the whole text is looked
    for. A text that many markers share is found and counted once per source and handed to its
    markers afterwards, so no line meets a marker. The plan does not grow with the markers, and one
    pass over the lines serves all of them up to some 800 000 different texts; beyond that there is
    a pass for each part. Lines are counted per task before the shuffle. `leaked` tells whether any
    such line holds `secret`.
    """
    keys = marker_keys(markers)
    size = F.sum(F.octet_length("sought") + F.octet_length("key") + 64)
    heads, total = keys.agg(F.collect_set(F.char_length(F.left("key", F.lit(HEAD)))), size).head()  # lengths from 0 to HEAD
    given = lines.select(F.col(source).alias("source"), F.col(text).alias("_text"), F.make_valid_utf8(text).alias("_valid"))
    windows = F.regexp_extract_all("_valid", F.lit(f"(?s)(?=(.{{0,{GRAM}}}))(?:.|\\z)"), F.lit(1))
    begun = given.select("*", F.posexplode(windows).alias("_at", "_window"))
    begun = begun.withColumn("_n", F.explode(F.array(*map(F.lit, sorted(heads))).cast("array<int>")))
    begun = begun.where(F.char_length("_window") >= F.col("_n")).withColumn("_head", F.left("_window", F.col("_n")))
    leaks = F.lit(False) if secret is None else F.col("_text").contains(secret)
    met = None
    for part in _in_parts(keys, total or 0):
        lengths = part.groupBy(F.left("key", F.lit(HEAD)).alias("_head")).agg(F.collect_set(F.char_length("key")).alias("_lengths"))
        # A part has a checked size; a broadcast keeps the pieces in the task that made them.
        found = begun.join(F.broadcast(lengths), "_head").withColumn("_length", F.explode("_lengths"))
        found = found.where(F.char_length("_window") >= F.col("_length")).withColumn("key", F.left("_window", F.col("_length")))
        found = found.join(F.broadcast(part), "key")
        # A key that a line has several times counts where it comes first.
        first = F.position("key", "_valid") == F.col("_at") + 1
        found = found.where(first & F.contains("_text", "sought")).groupBy("source", "sought").agg(
            F.count("*").alias("n_lines"), F.coalesce(F.bool_or(leaks), F.lit(False)).alias("leaked")
        )
        met = found if met is None else met.unionByName(found)
    named = markers.select("marker", "sought").distinct()
    return met.join(named, "sought").select("source", "marker", "n_lines", "leaked")


def coverage_table(
    lines: DataFrame, markers: DataFrame, sources: list[str], text: str = "text", source: str = "source"
) -> DataFrame:
    """`coverage_matrix` for markers that are a table: a row per marker, `YES` or `no` per source."""
    found = find_markers(lines.where(F.col(source).isin(sources)), markers, text, source)
    seen = found.groupBy("marker").agg(*[F.bool_or(F.col("source") == name).alias(f"_{j}") for j, name in enumerate(sources)])
    cells = [F.when(F.coalesce(f"_{j}", F.lit(False)), "YES").otherwise("no").alias(name) for j, name in enumerate(sources)]
    return markers.select("marker").distinct().join(seen, "marker", "left").select("marker", *cells)


def redaction_table(
    lines: DataFrame, markers: DataFrame, secret: str, text: str = "text", source: str = "source"
) -> DataFrame:
    """`redaction_check` for markers that are a table, of the pairs that are present: source, marker, leaked."""
    return find_markers(lines, markers, text, source, secret).select("source", "marker", "leaked")
