"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, as a whole, so its tokens are those of training. Each token's span of characters, from
the byte lengths of the tokens, is then joined to the sections' spans by sorted search, and a token that crosses a
boundary is allocated by an explicit rule:

* ``majority``: the section with most of its characters, the earlier one on a tie;
* ``start``: the section where it begins;
* ``split``: a share for each section, by characters.

Characters in no section count for none; ``majority`` then looks at the sections alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, in_chunks

RULES = ("majority", "start", "split")
#: Fixed pattern: how the public byte-level vocabulary cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The pattern's white space. The library reads a run of it anew for each of its characters, and a very
#: long one exceeds its stack; so runs are cut out beforehand, all but the short ones, whose cost is small.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{16,}")


@lru_cache(maxsize=4)
def byte_encoder(path: str):
    """The encoding of a vocabulary file of base64 tokens and ranks, and each id's length in bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(encoding, text: str) -> list[int]:
    """The ids of a whole text. A run of white space is the piece that the pattern would cut: all of it but the character
    before a following word, which begins the next piece. What lies between runs is encoded as it stands.
    """
    ids, at = [], 0
    for run in _SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        if at < run.start():
            ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def token_spans(ids: np.ndarray, lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token; one that holds part of a character spans the whole of it."""
    end = np.cumsum(lengths[ids])
    start = end - lengths[ids]
    lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    if lead.all():
        return start, end
    before = np.concatenate([[0], np.cumsum(lead)])  # characters that begin before a byte
    return before[start + 1] - 1, before[end]


def attribute(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; sections are sorted, apart, and may be empty."""
    n = len(section_start)
    tokens, crossing = np.zeros(n), np.zeros(n)
    if not n or not len(start):
        return tokens, crossing
    low = np.searchsorted(section_end, start, side="right")  # the first section that ends after the token's start
    high = np.searchsorted(section_start, end, side="left") - 1  # the last that begins before its end
    inside = (low == high) & (section_start[np.minimum(low, n - 1)] <= start) & (section_end[np.minimum(low, n - 1)] >= end)
    np.add.at(tokens, low[inside], 1)
    for t in np.flatnonzero(~inside & (low <= high)):
        near = np.arange(low[t], high[t] + 1)
        share = np.minimum(section_end[near], end[t]) - np.maximum(section_start[near], start[t])
        near, share = near[share > 0], share[share > 0]
        if not len(near):
            continue
        if rule == "split":
            tokens[near] += share / share.sum()
            crossing[near] += 1
            continue
        at = near[int(share.argmax())] if rule == "majority" else near[0] if section_start[near[0]] <= start[t] else -1
        if at >= 0:
            tokens[at] += 1
            crossing[at] += 1
    return tokens, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds; together they tile the text."""
    end = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 10) + 1
    if not len(end) or end[-1] != len(text):
        end = np.append(end, len(text))
    return np.concatenate([[0], end[:-1]]), end


def section_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "majority") -> DataFrame:
    """One row per section: doc_id, section, start, end (characters), n_tokens, n_crossing, doc_tokens.

    ``sections`` names a column of array<struct<start,end>>, sorted and apart; without it the lines of the text are
    the sections. A null or empty text has one empty line; a null or empty array of sections gives no row. Repeated
    rows each give their own. Texts of any length are encoded as wholes; long runs of one character, white space too,
    cost as much as other text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = byte_encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if sections else None
            for a, b in in_chunks(texts, 1_000_000):
                columns: list[list[np.ndarray]] = [[] for _ in arrow.names]
                for i in range(a, b):
                    body = texts[i] or ""
                    ids = np.array(encode(encoding, body), dtype=np.int64)
                    span = token_spans(ids, lengths, body.encode())
                    if given is None:
                        first, last = line_sections(body)
                    else:
                        held = given[i] or []
                        first, last = (np.array([s[k] for s in held], dtype=np.int64) for k in ("start", "end"))
                    tokens, crossing = attribute(*span, first, last, rule)
                    n = len(first)
                    for c, v in zip(columns, (np.full(n, i), np.arange(n), first, last, tokens, crossing, np.full(n, len(ids)))):
                        c.append(v)
                flat = [np.concatenate(c) for c in columns]
                out = [keys.take(pa.array(flat[0])), *(pa.array(c.astype(f.type.to_pandas_dtype()), type=f.type) for c, f in zip(flat[1:], list(arrow)[1:]))]
                yield pa.RecordBatch.from_arrays(out, schema=arrow)

    columns = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(sections)] if sections else [])]
    return docs.select(*columns).mapInArrow(run, schema)
