"""Saved filters, applied many at once."""

from dataclasses import asdict, dataclass, fields
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.levels import level_rank, levels_at_least, parse_level
from emberlog.functions.text import split_csv
from emberlog.operators.filters import FilterSpec, filter_chain
from emberlog.schema import LEVELS


@dataclass(frozen=True)
class Profile:
    """A saved set of options; null fields say nothing."""

    process: str | None = None
    pid: int | None = None
    subsystem: str | None = None
    category: str | None = None
    level: str | None = None
    grep: str | None = None
    exclude_grep: str | None = None
    format: str | None = None
    time: str | None = None
    info: bool | None = None
    debug: bool | None = None
    source: bool | None = None
    dedup: bool | None = None

    def is_empty(self) -> bool:
        return all(value is None for value in asdict(self).values())

    def overridden(self, other: "Profile | None") -> "Profile":
        """Fields set in `other` win over this profile's."""
        if other is None:
            return self
        pairs = {f.name: (getattr(other, f.name), getattr(self, f.name)) for f in fields(self)}
        return Profile(**{name: mine if theirs is None else theirs for name, (theirs, mine) in pairs.items()})

    def spec(self) -> FilterSpec:
        """The filter part; a level that does not exist counts as not set."""
        return FilterSpec(
            process=self.process,
            pid=self.pid,
            subsystem=self.subsystem,
            category=self.category,
            level=_known_level(self.level),
            grep=self.grep,
            exclude_grep=self.exclude_grep,
            info=bool(self.info),
            debug=bool(self.debug),
        )


def _known_level(level: str | None) -> str | None:
    try:
        return None if level is None else levels_at_least(level)[0]
    except ValueError:
        return None


def profile_match(logs: DataFrame, profiles: dict[str, Profile], overrides: Profile | None = None) -> DataFrame:
    """Rows with the `profile` they match, once per matching profile.

    Profiles are settings, so their conditions go into one projection: a single pass over the
    rows however many there are, with no join.
    """
    matches = [
        F.when(filter_chain(profile.overridden(overrides).spec().chain()), F.lit(name))
        for name, profile in profiles.items()
    ]
    return logs.withColumn("profile", F.explode(F.array_compact(F.array(*matches))))


# What a rule can be looked up by, the most selective first. A rule without any of them is tried on every row.
LOOKUPS = ("pid", "category", "process", "subsystem", "level")
CONDITIONS = (*LOOKUPS, "grep", "exclude_grep")


def _names_of(column: str) -> Column:
    """Comma-separated names as a list; null and blank ones say nothing."""
    return F.array_distinct(split_csv(F.coalesce(F.col(column), F.lit(""))))


def _shortest(prefixes: Column) -> Column:
    """The prefixes that no other of them is a prefix of: of those a text begins with one at most."""
    return F.filter(
        prefixes, lambda p: ~F.exists(prefixes, lambda other: (other != p) & F.startswith(p, other))
    )


def rule_index(profiles: DataFrame, overrides: Profile | None = None) -> DataFrame:
    """Profiles as (lookup, key, rule): one row per value that a row of the log may be found by.

    Every rule is entered under one kind of lookup, all values of it, so a row of the log meets a
    rule once at most. `rule` holds the whole condition.
    """
    changes = {name: value for name, value in asdict(overrides or Profile()).items() if value is not None}

    def option(name: str) -> Column:
        given = F.lit(changes[name]) if name in changes else F.col(name) if name in profiles.columns else F.lit(None)
        return given.cast("long" if name == "pid" else "string").alias(name)

    rules = profiles.select("profile", *map(option, CONDITIONS))
    level = parse_level(F.col("level"), unknown=None)
    # Levels in order; those from the rule's on pass.
    levels = F.filter(F.array(*map(F.lit, LEVELS)), lambda name: level_rank(name) >= level_rank(level))
    rules = rules.select(
        F.struct(
            "profile",
            "pid",
            F.transform(_names_of("process"), F.lower).alias("process"),
            _shortest(_names_of("subsystem")).alias("subsystem"),
            _names_of("category").alias("category"),
            F.coalesce(levels, F.array().cast("array<string>")).alias("level"),
            "grep",
            "exclude_grep",
        ).alias("rule")
    )
    rule = F.col("rule")
    values = {
        "pid": F.when(rule["pid"].isNotNull(), F.array(rule["pid"].cast("string"))),
        **{name: F.when(F.size(rule[name]) > 0, F.array_distinct(rule[name])) for name in LOOKUPS[1:]},
    }

    def entry(lookup: str, key: Column) -> Column:
        return F.struct(F.lit(lookup).alias("lookup"), key.alias("key"))

    # One kind of lookup per rule, the first that it has values of.
    entered = [F.transform(keys, partial(entry, name)) for name, keys in values.items()]
    return rules.select(F.inline(F.coalesce(*entered, F.array(entry("any", F.lit(""))))), "rule")


# Entries of the index that are sent to every task; more are joined by a shuffle.
SENT_ENTRIES = 100_000


def match_profiles(logs: DataFrame, profiles: DataFrame, overrides: Profile | None = None) -> DataFrame:
    """Rows with the `profile` they match, once per matching profile, for profiles that are a table.

    `profiles` has a column `profile` and any of the filter columns of `Profile`; lists are
    comma-separated, nulls and unknown levels say nothing, and `overrides` win. The plan is the
    same for ten profiles and ten thousand: a row's values, and the prefixes of its subsystem of
    the lengths that occur, are joined to the values that rules are entered under; what remains of
    a rule is tested on the rows found. Rows are exploded only to lookups that some rule has.
    """
    index = rule_index(profiles, overrides)
    used = index.agg(
        F.collect_set("lookup").alias("lookups"),
        F.collect_set(F.when(F.col("lookup") == "subsystem", F.length("key"))).alias("lengths"),
    )
    lookups, lengths = used.select("lookups").scalar(), used.select("lengths").scalar()

    def entry(lookup: str, value: Column) -> Column:
        return F.struct(F.lit(lookup).alias("lookup"), value.cast("string").alias("key"))

    subsystem = F.col("subsystem")
    rows = logs.withColumns({"_lengths": lengths, "_lookups": lookups})
    prefixes = F.transform(
        F.filter("_lengths", lambda n: n <= F.length(subsystem)), lambda n: entry("subsystem", F.substring(subsystem, F.lit(1), n))
    )
    values = F.array(
        entry("pid", F.col("pid")),
        entry("process", F.lower("processName")),
        entry("category", F.col("category")),
        entry("level", F.col("level")),
        entry("any", F.lit("")),
    )
    values = F.filter(
        F.concat(values, F.coalesce(prefixes, F.array().cast("array<struct<lookup:string,key:string>>"))),
        lambda v: v["key"].isNotNull() & F.array_contains(F.col("_lookups"), v["lookup"]),
    )
    rows = rows.select(*logs.columns, F.explode(values).alias("_value"))
    on = (F.col("_value.lookup") == F.col("lookup")) & (F.col("_value.key") == F.col("key"))
    entries = index.withColumnRenamed("rule", "_rule")
    # Few rules go to the rows, since a level or a process has a large share of all rows.
    few = index.limit(SENT_ENTRIES + 1).count() <= SENT_ENTRIES
    found = rows.join(F.broadcast(entries) if few else entries, on)
    rule = F.col("_rule")

    def passes(names: Column, test) -> Column:
        return (F.size(names) == 0) | F.coalesce(test(names), F.lit(False))

    def matches(pattern: Column) -> Column:
        return F.coalesce(F.rlike("message", F.concat(F.lit("(?iu)"), pattern)), F.lit(False))

    found = found.where(
        passes(rule["level"], lambda names: F.array_contains(names, F.col("level")))
        & (rule["pid"].isNull() | F.coalesce(rule["pid"] == F.col("pid"), F.lit(False)))
        & passes(rule["subsystem"], lambda names: F.exists(names, lambda p: F.startswith(subsystem, p)))
        & passes(rule["category"], lambda names: F.array_contains(names, F.col("category")))
        & passes(rule["process"], lambda names: F.array_contains(names, F.lower("processName")))
    )
    found = found.where(
        (rule["grep"].isNull() | matches(rule["grep"])) & (rule["exclude_grep"].isNull() | ~matches(rule["exclude_grep"]))
    )
    return found.select(*[c for c in logs.columns if c != "profile"], rule["profile"].alias("profile"))


def summarise_matches(logs: DataFrame, profiles: DataFrame, overrides: Profile | None = None) -> DataFrame:
    """Per profile that matches rows: profile, n, first, last, total (of `seq`), for profiles that are a table.

    `match_profiles` counted per profile, without a row for each pair: profiles that say the same
    are one rule, rows are matched and counted once per rule, and the counts go to its profiles.
    """
    says = F.to_json(F.struct(F.lit(0).alias("_"), *[name for name in CONDITIONS if name in profiles.columns]))
    named = profiles.select("profile", says.alias("_rule"))
    rules = profiles.withColumn("profile", says).dropDuplicates(["profile"])
    counted = match_profiles(logs, rules, overrides).groupBy(F.col("profile").alias("_rule")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("seq").alias("total")
    )
    # Profiles of one name count together, as often as they are listed.
    return named.join(counted, "_rule").groupBy("profile").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("total").alias("total")
    )
