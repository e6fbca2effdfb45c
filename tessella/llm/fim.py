"""Fill-in-middle: a text's middle goes to its end, with sentinels that tell the pieces apart."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, tidy

#: The sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The columns that transform() adds, by role.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def token_starts(code_points: np.ndarray) -> np.ndarray:
    """Where the tokens `[A-Za-z]+|[^A-Za-z]` of a text begin: everywhere but between two letters."""
    letter = ((code_points | 32) - 97) < 26  # unsigned: what lies below "a" wraps around
    new = np.ones(len(code_points), bool)
    new[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(new)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the digest of `seed:id`; a null id stands as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(doc_id: int | None, text: str, seed: int, plain_from: int, spm_below: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """ADDED of one whole text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = token_starts(points)
    n, (h1, h2, h3, h4) = len(starts), draws(doc_id, seed)
    if not text or h3 % 100 >= plain_from or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(starts[r]) if r < n else len(points) for r in (a, b)]
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in np.split(points, at))
    p, s, m = sentinels
    if h4 % 100 < spm_below:
        return n, "spm", at[0], at[1] - at[0], f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", at[0], at[1] - at[0], f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, str, str] = SENTINELS,
) -> tuple[DataFrame, dict[str, str]]:
    """docs with ADDED, and the names of these by role, changed where docs has one of them.

    n: the text's tokens. Two of its n + 1 token bounds, drawn from the id's digest, end the prefix and the middle; lengths are in code
    points. form: psm (prefix, suffix, middle), spm (suffix, prefix, middle), or plain, the text itself: for the ids whose third number mod 100 is
    plain_from or more, for empty texts, and for texts that hold a sentinel, which could not be taken apart again.

    A null text is empty. Bytes that are not UTF-8 become U+FFFD. Repeated rows get equal pieces, equal texts of other ids pieces of their own; a null id draws as an
    empty one. Rows neither move nor meet: each is cut in its Arrow batch, which holds 512 rows or 16 MB, or one longer text."""
    bound_batches(spark)
    names = dict(zip(ADDED, fresh(docs, *ADDED), strict=True))
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[r], k) for r, k in zip(ADDED, kinds, strict=True))])
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ((t or b"").decode("utf-8", "replace") for t in b.column(at_text).cast(pa.binary()).to_pylist())
            rows = [cut(i, t, seed, plain_from, spm_below, sentinels) for i, t in zip(b.column(at_id).to_pylist(), texts, strict=True)]
            more = [pa.array([r[k] for r in rows], pa.string() if kind == T.StringType() else pa.int64()) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return docs.mapInArrow(tidy(run), schema), names


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. No piece holds a sentinel, and no sentinel's end is its beginning, so the first one found is the one set."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> list[Column]:
        body = F.split(F.substr(output, F.lit(len(first) + 1)), re.escape(second), 2)
        return [body[0], *(F.split(body[1], re.escape(m), 2)[i] for i in (0, 1))]

    prefix, suffix, middle = parts(p, s)
    of_psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", of_psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
