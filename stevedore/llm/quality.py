"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document and leaves one bit in ``failed`` beside the measurements
it used. A policy is a set of bits, with a version; verdicts of any policy, and what each rule alone
decides (its ablation), then come from bitwise operations on the ledger, without reading a text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import fresh, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits")
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measures


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule(5, "capitals", "10 * n_upper > 6 * n_letters"),
    Rule(6, "few_letters", "10 * n_letters < 6 * word_chars"),
    Rule(7, "some_repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(8, "some_symbols", "10 * n_symbols > n_words"),
)
#: Versioned policies: the bits that reject. The base is part of each.
POLICIES = {"base": 0b11, "v1": 0b1111, "v2": 0b1111111, "strict": 0b111111111}
POLICY = "v2"


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in raw), np.int64, n)
    repeated = 0
    if n > 3 and len(places) < n:
        # Windows as numbers: pairs of words get dense ids first, so that no product overflows.
        _, pair = np.unique(ids[:-1] * len(places) + ids[1:], return_inverse=True)
        window = pair[:-1] * len(places) + ids[2:]
        _, which, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = count[which] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= twice
        repeated = int(covered.sum())
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    blank = sum(map(text.count, _SPACES))
    upper, letters, digits = _classes(text)
    return n, len(text) - blank, sum(map(text.count, SYMBOLS)), duplicates, repeated, lines, upper, letters, digits


@functools.cache
def _class_table() -> np.ndarray:
    """Of each code point: 1 upper-case letter, 2 other letter or a mark on one (vowel signs), 4 digit."""
    kinds = {"Lu": 1, "Nd": 4}
    names = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    return np.array([kinds.get(c) or (2 if c[0] in "LM" else 0) for c in names], np.uint8)


def _classes(text: str) -> tuple[int, int, int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_class_table()[codes], minlength=5)
    return int(kinds[1]), int(kinds[1] + kinds[2]), int(kinds[4])


def ledger(docs: DataFrame, *, text: str = "text", measures: str = "measures", failed: str = "failed") -> DataFrame:
    """Append ``measures`` (a struct of MEASURES) and ``failed`` (bits of the rules not met).

    Null texts count as empty: no words, so rule 0 fails. No shuffle. Rows equal in text are judged
    alike. Columns of those names must not exist (ValueError).
    """
    if clash := {measures.lower(), failed.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist; name the outputs otherwise")
    kind = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = [measure(t or "") for t in batch.column(text).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names=list(MEASURES))], names=[*batch.schema.names, measures])

    measured = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(measures, kind, False)]))
    bits = [F.when(_over(rule.fails, measures), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured.withColumn(failed, mask.cast("long"))


def _over(condition: str, struct: str) -> Column:
    for name in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(name, f"\0{MEASURES.index(name)}\0")
    for i, name in enumerate(MEASURES):
        condition = condition.replace(f"\0{i}\0", f"`{struct}`.`{name}`")
    return F.expr(condition)


def passes(failed: Column, policy: str) -> Column:
    """Whether a ledger entry meets a policy."""
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(entries: DataFrame, policy: str, *, failed: str = "failed") -> DataFrame:
    """For each rule of a policy: documents it fails, documents that it alone rejects, and how many
    the policy without it would keep. One row for each distinct mask leaves a task; an empty ledger
    gives zeros."""
    bits = POLICIES[policy]
    masks = entries.groupBy(F.col(failed).bitwiseAND(F.lit(bits)).alias("_mask")).agg(F.count("*").alias("_n"))
    rules = [r for r in RULES if bits >> r.bit & 1]
    hits = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    parts = F.array(*(F.struct(
        F.lit(r.name).alias("rule"),
        hits(F.col("_mask").bitwiseAND(F.lit(1 << r.bit)) != 0).alias("n_failed"),
        hits(F.col("_mask") == 1 << r.bit).alias("n_only_this"),
        hits(F.col("_mask").bitwiseAND(F.lit(bits & ~(1 << r.bit))) == 0).alias("n_kept_without"),
    ) for r in rules))
    return masks.agg(parts.alias("_r")).select(F.inline("_r"))


def verdicts(docs: DataFrame, *, policy: str = POLICY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, measures, failed bits, base_failed, and ``kept`` by the policy."""
    entries = ledger(docs.select(doc_id, text), text=text)
    base = ~passes(F.col("failed"), "base")
    shown = [F.col(f"measures.{m}").alias(m) for m in MEASURES[:5]]
    return entries.select(doc_id, *shown, base.alias("base_failed"), (~base & passes(F.col("failed"), policy)).alias("kept"), "failed")


def keep(docs: DataFrame, *, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The rows and columns of documents that the base and the policy keep."""
    measures, failed = fresh(docs.columns), fresh(docs.columns)
    entries = ledger(docs, text=text, measures=measures, failed=failed)
    return entries.filter(passes(F.col(failed), "base") & passes(F.col(failed), policy)).drop(measures, failed)
