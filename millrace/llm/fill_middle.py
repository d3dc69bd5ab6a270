"""Fill-in-the-middle: texts cut at two unit boundaries and put together anew around three marks.

A text is taken apart into chunks that overlap by one character, so a boundary, which is a matter of two adjacent
characters, belongs to exactly one chunk and is seen whole there. Chunks are counted each by itself; running sums of
the counts say which chunk owns each of the two cuts, and only those chunks are read again. Everything is
expressions on a row: no shuffle, and time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units, by the characters on both sides of a boundary: what ends before it and what begins after it.
UNITS = {"lines": (r"\n", r"[\s\S]"), "words": (r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"), "characters": (r"[\s\S]", r"[\s\S]")}

#: Prefix, suffix and middle marks.
MARKS = ("<P>", "<S>", "<M>")
CHUNK = 4096


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Runs of ``size`` code points, each with the first one of the next run."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + 1}}})).{{1,{size}}}"), F.lit(1))


def boundary_counts(parts: Column, unit: str) -> Column:
    """Boundaries that each chunk owns."""
    before, after = UNITS[unit]
    return F.transform(parts, lambda p: F.regexp_count(p, F.lit(f"{before}(?={after})")))


def running_sums(counts: Column) -> Column:
    """Boundaries before each chunk, and after the last one all of them."""
    zero = F.array(F.lit(0))
    return F.aggregate(counts, zero, lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))


def cut_at(parts: Column, sums: Column, rank: Column, chars: Column, unit: str, size: int = CHUNK) -> Column:
    """Code points before boundary number ``rank``: none before number 0, all before the one after the last."""
    before, after = UNITS[unit]
    owner = F.array_position(F.transform(F.slice(sums, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: s >= rank), True).cast("int")
    piece = F.lit(f"(?s).*?{before}(?={after})")

    def within(k: Column) -> Column:
        pieces = F.slice(F.regexp_extract_all(F.element_at(parts, k), piece, F.lit(0)), 1, rank - F.element_at(sums, k))
        return (k - 1) * size + F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p))

    return F.when(rank <= 0, F.lit(0)).when(rank > F.element_at(sums, -1), chars).otherwise(let(owner, within))


def seeded(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight hexadecimal digits of the key's hash, as unsigned integers; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines", seed: int = 7, rate: int = 100, suffix_first: int = 50, size: int = CHUNK
) -> DataFrame:
    """``df`` with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null where plain), and the output.

    Cuts and form depend on the key alone, so equal rows are cut alike. A null or empty text, one that holds a mark,
    and what ``rate`` percent leave over, stay plain: their output is the text, for null the empty one. Columns of
    ``df`` with these names are replaced.
    """
    h1, h2, h3, h4 = seeded(F.col(key), seed)
    body = F.coalesce(F.col(text), F.lit(""))
    marked = [F.contains(body, F.lit(m)) for m in MARKS]
    form = F.when((body == "") | marked[0] | marked[1] | marked[2] | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")

    def cuts(parts: Column) -> Column:
        def ranked(sums: Column) -> Column:
            n = F.when(body == "", F.lit(0)).otherwise(F.element_at(sums, -1) + 1)
            a, b = (h1 % (n + 1)).cast("int"), (h2 % (n + 1)).cast("int")
            chars = F.length(body)
            at = lambda rank: cut_at(parts, sums, rank, chars, unit, size)
            return F.struct(n.cast("long").alias("n"), at(F.least(a, b)).cast("long").alias("first"), at(F.greatest(a, b)).cast("long").alias("second"))

        return let(running_sums(boundary_counts(parts, unit)), ranked)

    taken = ("__cuts", "n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in df.columns if c == text or c == key or c not in taken]
    cut = df.select(*rest, let(chunks(body, size), cuts).alias("__cuts"), form.alias("form"))
    first, second = F.col("__cuts.first"), F.col("__cuts.second")
    whole = F.col("form") == "plain"
    prefix, suffix = F.substring(body, F.lit(1), first.cast("int")), F.substring(body, (second + 1).cast("int"), F.length(body))
    middle = F.substring(body, (first + 1).cast("int"), (second - first).cast("int"))
    p, s, m = map(F.lit, MARKS)
    output = F.when(whole, body).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return cut.select(
        *rest, F.col("__cuts.n").alias("n"), "form", F.when(~whole, first).alias("prefix_chars"), F.when(~whole, second - first).alias("middle_chars"), output.alias("output")
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(MARKS))
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))


def middle_digests(docs: DataFrame) -> DataFrame:
    """Per document: units, form, lengths of the parts, and hashes of the output and of the text restored from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
