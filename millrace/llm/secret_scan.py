"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned once for candidates; each candidate keeps its kind, its place in code points and the SHA-256
of its value, never the value itself. The hashes are then aggregated over the whole corpus by distinct owners and
distinct repositories (documents of an owner): a value that many owners hold, or that stands in many repositories of
one owner, is a copied example; one that few hold and that looks random is taken for a live credential of its owner.

A scan gives the lengths of matches and of the pieces between them; their running sums over exploded rows are the
positions, so a text with many matches costs as much a match as one with few. A hot value is first reduced to one row
per (hash, owner, repository), on the map side; the counts are written before they are joined to the candidates, and
a join of two plain exchanges is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Kind, pattern, group with the value, least code points of that group, group that stands before the span (0: none).
#: A web token is tried at the first "eyJ" of a run only: where that one fails, those after it in the run fail too.
DETECTORS: list[tuple[str, str, int, int, int]] = [
    ("assign", r"""((?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, 0),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, 0),
    ("hex", r"[0-9a-f]{16,}", 0, 16, 0),
    ("jwt", r"(?<![A-Za-z0-9_-])((?>[A-Za-z0-9_-]*?(?=eyJ)))(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++)", 2, 30, 1),
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})", 0, 20, 0),
]
BASE_KINDS = ("assign", "access", "hex")
#: Words that mark a value as a stand-in.
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|your[_-]?|123456|abcdef"
REDACTED = "[REDACTED]"

#: A value is a shared example where more owners than this hold it, or where it stands in more repositories than this.
MOST_OWNERS, MOST_REPOSITORIES = 2, 20
_HIT = "array<struct<rank:int,nth:int,gap:int,length:int,valid:boolean,hash:string,random:boolean>>"


def _looks_live(value: Column) -> Column:
    """Letters and digits, at least six different characters, no stand-in words."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 6
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def _hits(text: Column, rank: int, pattern: str, group: int, least: int, lead: int) -> Column:
    """Leftmost non-overlapping matches of one detector in order: length of the piece before, own length, value's hash."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)

    def hit(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        before = F.length(F.regexp_extract(x["hit"], pattern, lead)) if lead else F.lit(0)
        return F.struct(
            F.lit(rank).alias("rank"), i.alias("nth"), (x["gap"] + before).alias("gap"), (F.length(x["hit"]) - before).alias("length"),
            (F.length(value) >= least).alias("valid"), F.sha2(value, 256).alias("hash"), _looks_live(value).alias("random"),
        )

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    return F.when(text.rlike(pattern), F.transform(zipped, hit)).otherwise(F.array().cast(_HIT))


def _every_hit(text: str) -> Column:
    body = F.coalesce(F.col(text), F.lit(""))
    return F.concat(*[_hits(body, i, *rest) for i, (_, *rest) in enumerate(DETECTORS)])


def spans(hits: DataFrame) -> DataFrame:
    """A written table of candidates of (row_id, doc_id, owner, hits) rows: start, end, rank of the detector, hash, random.

    Candidates with too short a value are left out, after their lengths have counted.
    """
    one = hits.where(F.size("hits") > 0).select("row_id", "doc_id", "owner", F.explode("hits").alias("hit")).select("row_id", "doc_id", "owner", "hit.*")
    order = Window.partitionBy("row_id", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order)).where("valid")
    return materialize(placed.select("row_id", "doc_id", "owner", (F.col("end") - F.col("length")).alias("start"), "end", "rank", "hash", "random"), "secret-spans")


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """A written table, one row per candidate hash: distinct owners, distinct repositories, and whether it is ``shared``.

    A repository is a document id of an owner; a null owner is an owner, and a null id a repository, of its own, so
    repeated rows count once.
    """
    one = found.select("hash", F.struct("owner").alias("held"), "doc_id").distinct()
    by_owner = one.groupBy("hash", "held").agg(F.count(F.lit(1)).alias("n"))
    counts = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    shared = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    return materialize(counts.withColumn("shared", shared), "secret-owners")


def judged(found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Candidates with the counts of their hash, ``shared``, and ``live``: random-looking and not shared."""
    return found.join(ownership(found, most_owners, most_repositories), "hash").withColumn("live", F.col("random") & ~F.col("shared"))


def _listed(ranks: list[int] | None = None) -> Column:
    """A row's candidates of some detectors as kind:start:end, by start, then in the order of the detectors."""
    row = F.struct("start", "rank", "end")
    held = F.array_sort(F.collect_list(row if ranks is None else F.when(F.col("rank").isin(ranks), row)))
    kinds = F.array(*[F.lit(kind) for kind, *_ in DETECTORS])
    return F.array_join(F.transform(held, lambda x: F.concat_ws(":", kinds[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """Per row of ``docs``: counts of base candidates, digest of their spans, all spans, and what ownership says of them.

    A null or empty text has no spans: counts 0, the digest of the empty string, ``spans`` empty. Repeated rows each
    give a row. ``n_live`` counts owner-specific random-looking candidates, ``n_shared`` those that more than
    ``most_owners`` owners or ``most_repositories`` repositories hold; ``max_owners`` and ``max_repositories`` are those
    of the most widely held candidate (0 without candidates).
    """
    # the row id is written with the rows, so repeated rows and null keys stay apart
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("doc_id"), F.col(owner).alias("owner"), _every_hit(text).alias("hits"))
    scanned = materialize(rows, "secret-scan")
    found = judged(spans(scanned), most_owners, most_repositories)
    base = [i for i, (kind, *_) in enumerate(DETECTORS) if kind in BASE_KINDS]
    counts = {f"n_{DETECTORS[i][0]}": F.count_if(F.col("rank") == i) for i in base}
    counts |= {"n_live": F.count_if("live"), "n_shared": F.count_if("shared"), "max_owners": F.max("n_owners"), "max_repositories": F.max("n_repositories")}
    by_row = found.groupBy("row_id").agg(_listed(base).alias("base"), _listed().alias("spans"), *[c.alias(n) for n, c in counts.items()])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return scanned.select("row_id", "doc_id").join(by_row, "row_id", "left").select(
        "doc_id",
        *[number(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[number(c) for c in ("n_live", "n_shared", "max_owners", "max_repositories")],
    )


def _without(text: Column, live: Column, pattern: str, group: int) -> Column:
    """``text`` with the values of one detector's matches replaced where their hash is in one of the buckets ``live``."""

    def clean(hit: Column) -> Column:
        value = F.regexp_extract(hit, pattern, group) if group else hit
        digest = F.sha2(value, 256)
        bucket = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % F.size(live)
        return F.when(F.array_contains(live[bucket], digest), F.replace(hit, value, F.lit(REDACTED))).otherwise(hit)

    between = F.split(text, pattern, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), clean)
    rest = F.zip_with(hits, F.slice(between, F.lit(2), F.size(hits)), lambda h, g: F.concat(h, g))
    return F.concat(between[0], F.array_join(rest, ""))


def redact(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """``docs`` with every owner-specific live-looking credential replaced in ``text``; shared examples stay.

    The values are found again, detector by detector, where the document has a live hash, and compared by hash. All
    rows and columns are kept; rows equal in key, owner and text are one to the scan.
    """
    marked = docs.withColumn("__row", F.struct(F.col(key).alias("k"), F.col(owner).alias("o"), F.xxhash64(text).alias("t")))
    rows = marked.select(F.col("__row").alias("row_id"), F.col(key).alias("doc_id"), F.col(owner).alias("owner"), _every_hit(text).alias("hits"))
    hits = materialize(rows.where(F.size("hits") > 0).dropDuplicates(["row_id"]), "secret-hits")
    found = judged(spans(hits), most_owners, most_repositories).where("live")
    held = found.groupBy(F.col("row_id").alias("__hit")).agg(F.collect_set("hash").alias("hashes"))
    # many hashes are dealt into 256 buckets by their first byte, so each match is compared with few
    first = lambda h: F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.filter("hashes", lambda h: first(h) == b))
    live = held.select("__hit", F.when(F.size("hashes") > 64, dealt).otherwise(F.array("hashes")).alias("__live"))
    out = marked.join(live, marked["__row"].eqNullSafe(live["__hit"]), "left")
    for _, pattern, group, _, _ in DETECTORS:
        out = out.withColumn(text, F.when(F.col("__live").isNotNull(), _without(F.col(text), F.col("__live"), pattern, group)).otherwise(F.col(text)))
    return out.select(*docs.columns)
