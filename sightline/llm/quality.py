"""Quality rules as a bitmask ledger.

Each rule is evaluated once: the ledger holds every measurement and one failure
bit a rule. A policy is a versioned mask over those bits, so applying or
comparing policies, and ablations (what would be kept without a rule), need the
bits alone and no text.

Words are runs of anything but ASCII white space. Defined cases: a null or
empty text has no words, fails the rules that need words, and no other; equal
rows give equal rows; an empty table gives an empty ledger; columns that clash
with a measurement's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import as_bytes, table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_exclaims", "n_upper"]

#: Name and failing condition (SQL over the measures) of each rule; a rule's bit is its place here, so new rules go at the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("letterless_words", "100 * n_letter_words < 70 * n_words"),
    ("exclamations", "10 * n_exclaims > 3 * n_words"),
    ("upper_case", "10 * n_upper > 3 * word_chars"),
]

#: The rules of each version of the policy.
POLICIES: dict[str, list[str]] = {"base": ["few_words", "repeated_windows"], "v1": [name for name, _ in RULES]}

_SPACE = b" \t\n\r\x0b\f"
_LETTERS = frozenset([*range(65, 91), *range(97, 123), *range(128, 256)])
_NOT_IN_WORDS = bytes(b for b in range(256) if b not in _LETTERS and b not in _SPACE)
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(known) + ids[2:]
    if len(np.unique(keys)) == len(keys):
        return 0
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text (UTF-8), in the order of MEASURES."""
    words = text.split()
    packed = text.translate(None, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(packed.translate(None, _CONTINUED)),
        len(packed) - len(packed.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text.translate(None, _NOT_IN_WORDS).split()),
        text.count(b"!"),
        len(packed.translate(None, _UPPER)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES]])
    for batch in batches:
        if batch.num_rows:
            rows = zip(*map(measure, as_bytes(batch.column("text"))), strict=True)
            yield table(schema, doc_id=batch.column("doc_id"), **dict(zip(MEASURES, rows, strict=True)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and failures (a bit for each rule that fails) of each document; one scan, no shuffle."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES)]
    return measured.withColumn("failures", sum(bits[1:], bits[0]).cast("long"))


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def fails(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy, from a ledger: documents that fail it, that fail it alone, and that the policy keeps with and without it. Counts meet by distinct bit pattern (2**rules at most) before anything else."""
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = patterns.select("failures", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules])).alias("r")).select("failures", "n", "r.*")
    within = F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long"))
    kept = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("rule").agg(
        kept(within.bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        kept(within == F.col("bit")).alias("n_fail_alone"),
        kept(within == 0).alias("n_kept"),
        kept((within == 0) | (within == F.col("bit"))).alias("n_kept_without"),
    )
