"""Secret scans with corpus-wide ownership of candidates.

Patterns find candidates in whole texts. A candidate's digest is then counted
over distinct repositories and owners: what many owners or many repositories
hold is a copied example, what few hold looks live. The candidates that the fixed patterns
miss are reported where they look live; those of the fixed patterns always are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from trackwake.llm.common import checkpointed

MAX_OWNERS = 2
#: An example copied through one source is in more documents of it than this.
MAX_REPOS = 8
SALTS = 8


class Scan(NamedTuple):
    """A regex for Java; a match begins after its group `lead`, `group` is the secret."""

    regex: str
    lead: int
    group: int


class Pattern(NamedTuple):
    """Matches of `regex` whose `group` has at least `least` characters.

    `scan` is what texts are searched with where it differs: it finds the same
    without bounds on length. The SQL twin, whose regexes know neither look-behind
    nor possessive repeats, has `regex`.
    """

    kind: str
    regex: str
    group: int
    least: int
    scan: Scan | None = None


_NAMES = "(password|passwd|secret|token|api_?key)"
_EITHER_CASE = "".join(
    f"[{c.upper()}{c}]" if c.isalpha() else c for c in _NAMES
)

#: Always reported, in this order at one place.
BASE = (
    Pattern("assign", _EITHER_CASE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of 32 is where the maximal run of 32 or more starts and ends.
    Pattern("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Reported where few owners and repositories hold the candidate. A scan tries a
#: run of characters only at the run's start and never gives back, so that a long
#: text is scanned in linear time. In a run only the first `eyJ` can begin a token
#: that a later one does not: it has the longest part before the dot.
EXTRA = (
    Pattern(
        "jwt",
        r"eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}",
        0,
        28,
        Scan(
            r"(?<![A-Za-z0-9_-])(?>([A-Za-z0-9_-]*?)(?=eyJ))"
            r"(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
            1,
            2,
        ),
    ),
    Pattern("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{16,})", 1, 16),
    Pattern("vendor", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    Pattern(
        "url_login",
        r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@]{1,64}:([^\s/:@]{8,200})@",
        1,
        8,
        Scan(
            r"(?<![a-z0-9+.-])([0-9+.-]*+)[a-z][a-z0-9+.-]*+://[^\s/:@]++:([^\s/:@]{8,}+)@", 1, 2
        ),
    ),
    Pattern("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}", 0, 32),
)


def _spans(text: Column, pattern: Pattern, rank: int) -> Column:
    """Array of (start, rank, kind, end, secret) in code points, leftmost first.

    The pieces between matches and the matches take turns, so their lengths
    give every place without a search for it.
    """
    regex, lead, group = pattern.scan or Scan(pattern.regex, 0, pattern.group)
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    leads = F.regexp_extract_all(text, F.lit(regex), F.lit(lead))
    secrets = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    between = F.split(text, regex, -1)
    ahead = lambda i: F.length(F.get(leads, i)) if lead else F.lit(0)
    steps = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.struct(
            (F.length(F.get(between, i)) + ahead(i)).alias("skip"),
            (F.length(F.get(found, i)) - ahead(i)).alias("size"),
            F.get(secrets, i).alias("secret"),
        ),
    )
    none = F.array().cast(
        "array<struct<start:int,rank:int,kind:string,end:int,secret:string>>"
    )
    placed = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda held, s: F.struct(
            (held["at"] + s["skip"] + s["size"]).alias("at"),
            F.when(
                F.length(s["secret"]) >= pattern.least,
                F.concat(
                    held["spans"],
                    F.array(
                        F.struct(
                            (held["at"] + s["skip"]).alias("start"),
                            F.lit(rank).alias("rank"),
                            F.lit(pattern.kind).alias("kind"),
                            (held["at"] + s["skip"] + s["size"]).alias("end"),
                            s["secret"].alias("secret"),
                        )
                    ),
                ),
            )
            .otherwise(held["spans"])
            .alias("spans"),
        ),
        lambda held: held["spans"],
    )
    return F.when(text.rlike(regex), placed).otherwise(none)


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def candidates(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    owner: str = "source",
    text: str = "text",
    base: Sequence[Pattern] = BASE,
    extra: Sequence[Pattern] = EXTRA,
) -> DataFrame:
    """doc_id, owner and `spans`, sorted by place and pattern, for every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    patterns = [*base, *extra]
    spans = F.sort_array(
        F.concat(*(_spans(F.col("_text"), p, i) for i, p in enumerate(patterns)))
    )
    return docs.select(
        F.col(id).alias("doc_id"), F.col(owner).alias("owner"), whole.alias("_text")
    ).select("doc_id", "owner", spans.alias("spans"))


def ownership(scanned: DataFrame) -> DataFrame:
    """digest, n_owners and n_repos of every distinct candidate.

    Distinct (digest, owner) and (digest, repository) pairs are formed before
    and after the shuffle, so a candidate that a third of all rows hold is
    counted in many tasks. A null owner is one more owner.
    """
    held = scanned.where(F.size("spans") > 0).select(
        "doc_id", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["digest"]))).alias("digest")
    )
    repos = held.groupBy("digest", "owner", "doc_id").agg(F.lit(1).alias("_one"))
    owners = repos.groupBy("digest", "owner").agg(F.count("*").alias("_repos"))
    return owners.groupBy("digest").agg(
        F.count("*").alias("n_owners"), F.sum("_repos").alias("n_repos")
    )


def scan_secrets(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    owner: str = "source",
    text: str = "text",
    base: Sequence[Pattern] = BASE,
    extra: Sequence[Pattern] = EXTRA,
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """doc_id, base_spans, spans, n_live and n_copied for every row of `docs`.

    Documents stand for repositories, each within its owner. A candidate is live
    where at most `max_owners` owners and at most `max_repos` repositories hold
    it. `base_spans` are the spans of `base`; `spans` adds the live ones of
    `extra`. Spans are (kind, start, end, live, n_owners, n_repos). A null
    text counts as empty, and rows without a candidate have empty arrays. Rows
    that share a doc_id keep their own spans.
    """
    scanned = candidates(docs, id=id, owner=owner, text=text, base=base, extra=extra)
    digested = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["rank"].alias("rank"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["secret"], 256).alias("digest"),
        ),
    )
    # Read twice below: the texts are scanned once, the secrets are not kept.
    scanned = checkpointed(
        scanned.select(
            "doc_id", "owner", F.monotonically_increasing_id().alias("_row"), digested.alias("spans")
        )
    )
    # A digest that a third of all rows hold meets its count in SALTS places.
    counted = ownership(scanned).select(
        "digest",
        ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live"),
        "n_owners",
        "n_repos",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    spans = scanned.where(F.size("spans") > 0).select(
        "_row",
        F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("_deal"),
        F.explode("spans").alias("s"),
    )
    judged = (
        spans.join(
            counted,
            (F.col("s.digest") == F.col("digest")) & (F.col("_deal") == F.col("_salt")),
        )
        .groupBy("_row")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("s.start").alias("start"),
                        F.col("s.rank").alias("rank"),
                        F.col("s.kind").alias("kind"),
                        F.col("s.end").alias("end"),
                        "live",
                        "n_owners",
                        "n_repos",
                    )
                )
            ).alias("_spans")
        )
        .withColumnRenamed("_row", "_at")
    )
    none = F.array().cast(
        "array<struct<start:int,rank:int,kind:string,end:int,live:boolean,"
        "n_owners:bigint,n_repos:bigint>>"
    )
    rows = scanned.join(judged, F.col("_row") == F.col("_at"), "left").select(
        "doc_id", F.coalesce("_spans", none).alias("_spans")
    )
    count = lambda live: F.size(F.filter("_spans", lambda s: s["live"] == live))
    shown = lambda spans: F.transform(
        spans,
        lambda s: F.struct(
            *(s[k].alias(k) for k in ("kind", "start", "end", "live", "n_owners", "n_repos"))
        ),
    )
    return rows.select(
        "doc_id",
        shown(F.filter("_spans", lambda s: s["rank"] < len(base))).alias("base_spans"),
        shown(F.filter("_spans", lambda s: (s["rank"] < len(base)) | s["live"])).alias("spans"),
        count(True).cast("long").alias("n_live"),
        count(False).cast("long").alias("n_copied"),
    )
