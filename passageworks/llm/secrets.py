"""Secret scan with corpus-wide ownership frequency.

Each text is matched against the kinds below.  The SHA-256 of every candidate's value is
counted over the whole corpus by distinct owners and by distinct repositories of those
owners: a value that several owners hold, or very many repositories of few owners, is a
widely copied example; one of few owners and repositories looks live.  Base kinds are always
reported; the further kinds are reported where they look live.

Matching is row-local; only hashes, owners and places are shuffled.  The counts are
taken in steps (value, owner, repository), (value, owner), (value), each pre-aggregated
in its tasks, so a value in a third of all rows makes no heavy task.  Spans get the counts of
values with more than one in `HOT_SHARE` of all places by broadcast, since fewer than
`HOT_SHARE` values can have that many; the others join by value.

Defined cases: a null text is empty and has no span; a null owner or repository counts
as one owner or repository of its own; rows that repeat an id or a whole row are scanned
each by itself; equal values in one repository count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.columns import matches, picked, whole
from passageworks.session import stored

#: Owners from which on a value is a widely copied example.
EXAMPLE_OWNERS = 3
#: Distinct repositories from which on it is one within fewer owners, too.
EXAMPLE_REPOSITORIES = 100
HOT_SHARE = 1_000


@dataclass(frozen=True)
class Kind:
    """A candidate form; `least` characters of group `group` are needed."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


KINDS = (
    Kind(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, True,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # Runs of 24 and more: the same matches as all runs, without the short ones' cost.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind("upper_hex", r"(?<![0-9A-Fa-f])[0-9A-F]{32,}(?![0-9A-Fa-f])"),
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Kind("prefixed", r"(?<![A-Za-z0-9])(?:gh[pousr]|glpat|xox[abprs]|[sprk]k)[_-][A-Za-z0-9_-]{16,}"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"),
    Kind("url_password", r"://[^\s:/@]{1,64}:([^\s:/@]{1,128})@", 1, 6),
)
BASE_KINDS = sum(k.base for k in KINDS)


def candidates(text: Column) -> Column:
    """Array of (start, rank, stop, kind, value), by start and then by kind."""

    def of(rank: int, kind: Kind) -> Column:
        def value(x: Column) -> Column:
            return x["hit"] if kind.group == 0 else F.regexp_extract(x["hit"], kind.pattern, kind.group)

        return F.transform(
            F.filter(matches(text, kind.pattern), lambda x: F.length(value(x)) >= kind.least),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"),
                F.lit(kind.name).alias("kind"), F.sha2(value(x), 256).alias("value"),
            ),
        )

    return F.sort_array(F.concat(*(of(i, k) for i, k in enumerate(KINDS))))


def candidate_rows(
    docs: DataFrame, *, id_col: str, text_col: str, owner_col: str, repository_col: str
) -> DataFrame:
    """Per row: `row` (its number in this table), doc_id, owner, repository, spans; stored."""
    own = picked(docs, doc_id=id_col, text=text_col, owner=owner_col, repository=repository_col)
    found = own.select(
        "doc_id", "owner", "repository", candidates(whole(F.col("text"))).alias("spans"),
        F.xxhash64("doc_id", "text").alias("text_key"),
    )
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")


def ownership(rows: DataFrame) -> DataFrame:
    """Per candidate value: distinct owners, and distinct repositories within owners."""
    held = rows.select(F.explode("spans.value").alias("value"), "owner", "repository")
    return (
        held.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
        .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("places").alias("places"))
        .groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"),
            F.sum("places").alias("places"),
        )
    )


def with_counts(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """Spans with the counts of their values; values of very many places are not shuffled."""
    total = counts.agg(F.sum("places")).first()[0] or 0
    hot = F.col("places") * HOT_SHARE > total
    often = counts.where(hot)
    return (
        spans.join(F.broadcast(often), "value")
        .unionByName(
            spans.join(F.broadcast(often.select("value")), "value", "left_anti").join(counts.where(~hot), "value")
        )
    )


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """Per row of `docs`: doc_id, text_key and `spans`.

    `spans` has (start, rank, stop, kind, value, owners, repositories, live), by start
    and kind: all base spans, and of the other kinds those that look live.
    `text_key` is xxhash64(id, text), to join the spans to their texts.
    """
    rows = candidate_rows(
        docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repository_col=repository_col
    )
    spans = rows.where(F.size("spans") > 0).select("row", "doc_id", "text_key", F.explode("spans").alias("s"))
    flat = spans.select("row", "doc_id", "text_key", "s.*")
    counts = stored(ownership(rows), "secret-owners")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = with_counts(flat, counts).withColumn("live", live)
    packed = F.struct("start", "rank", "stop", "kind", "value", "owners", "repositories", "live")
    # A row whose candidates all went still is a row: keep it by an aggregate that drops nulls.
    shown = F.when((F.col("rank") < BASE_KINDS) | F.col("live"), packed)
    some = judged.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("text_key").alias("text_key"),
        F.sort_array(F.collect_list(shown)).alias("spans"),
    ).drop("row")
    none = rows.where(F.size("spans") == 0).select(
        "doc_id", "text_key", F.array().cast(some.schema["spans"].dataType).alias("spans")
    )
    return some.unionByName(none)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and texts of the spans of `scan`, per row."""

    def text_of(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def most(name: str) -> Column:
        return F.coalesce(F.array_max(F.transform("spans", lambda s: s[name])), F.lit(0)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < BASE_KINDS)
    return scanned.select(
        "doc_id",
        *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
        most("owners").alias("most_owners"),
        most("repositories").alias("most_repositories"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the union of the spans replaced by `mark`; spans sorted by start."""
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at")
    )

    def piece(a: Column, b: Column) -> Column:
        return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(state: Column, s: Column) -> Column:
        return (
            F.when(s["stop"] <= state["at"], state)
            .when(
                (s["start"] < state["at"]),
                F.struct(state["parts"].alias("parts"), s["stop"].alias("at")),
            )
            .otherwise(
                F.struct(
                    F.array_append(state["parts"], piece(state["at"], s["start"])).alias("parts"),
                    s["stop"].alias("at"),
                )
            )
        )

    end = F.length(text).cast("long")
    return F.aggregate(
        spans, start, step,
        lambda x: F.array_join(F.array_append(x["parts"], piece(x["at"], end)), mark),
    )
