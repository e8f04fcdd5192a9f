"""Languages told by profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of a profile, longest n-gram, and characters below which a text is not judged.
RANKS, LONGEST, LEAST = 300, 3, 100
_BITS = 21  # of a code point


def letters(text: Column) -> Column:
    """Lower-case words of letters with one space before and after each; a lone space where there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(spaced: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of all n-grams of 1 to 3 characters but lone spaces, which a doubled space cannot be part of. A code is the
    characters' code points in 21 bits each, so codes sort as the n-grams do."""
    c = np.frombuffer(" ".join(spaced.split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(c):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    c = np.concatenate(([32], c, [32]))
    one = c << (2 * _BITS)
    two = one[:-1] | c[1:] << _BITS
    return np.unique(np.concatenate((one[c != 32], two, two[:-1] | c[2:])), return_counts=True)


def gram_text(code: int) -> str:
    return "".join(chr(x) for x in (code >> (2 * _BITS), code >> _BITS & (1 << _BITS) - 1, code & (1 << _BITS) - 1) if x)


def ranked_grams(codes: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent codes, of equal counts the first in order."""
    return codes[np.lexsort((codes, -counts))[:ranks]]


def language_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", ranks: int = RANKS) -> DataFrame:
    """(lang, rank, gram, n): each language's most frequent n-grams, from 1. Rows without a language are left out; counts are
    summed in a task before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[str]] = {}
            for of, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(of, []).append(t)
            for of, some in texts.items():
                codes, counts = (np.concatenate(x) for x in zip(*map(grams, some), strict=True))
                distinct, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(distinct), pa.string()), pa.array(distinct), pa.array(n)], names=["lang", "code", "n"])

    found = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), letters(F.col(text))).mapInArrow(run, "lang string, code bigint, n bigint")
    summed = found.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code")))
    part = lambda shift: F.shiftright("code", shift).bitwiseAND((1 << _BITS) - 1)
    char = lambda c: F.when(c > 0, F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).otherwise("")
    top = summed.withColumn("rank", rank).filter(F.col("rank") <= ranks)
    return top.select("lang", F.col("rank").cast("bigint").alias("rank"), F.concat(*[char(part(s)) for s in (2 * _BITS, _BITS, 0)]).alias("gram"), "n")


def profile_codes(profiles: DataFrame) -> dict[str, np.ndarray]:
    """Each language's codes in order of rank: ``RANKS`` numbers a language."""
    out: dict[str, list] = {}
    for r in profiles.orderBy("lang", "rank").collect():
        points = [ord(x) for x in r["gram"]] + [0, 0]
        out.setdefault(r["lang"], []).append(points[0] << 2 * _BITS | points[1] << _BITS | points[2])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def out_of_place(text_ranks: np.ndarray, profile: np.ndarray, ranks: int = RANKS) -> int:
    """The sum over the text's n-grams of how far their ranks are from the profile's; ``ranks`` for one that it lacks."""
    by = np.argsort(profile)
    at = np.minimum(np.searchsorted(profile[by], text_ranks), len(profile) - 1)
    there = profile[by][at] == text_ranks
    return int(np.where(there, np.abs(by[at] - np.arange(len(text_ranks))), ranks).sum())


def language_by_profile(docs: DataFrame, profiles: DataFrame, key: str, text: str = "text", ranks: int = RANKS, least: int = LEAST) -> DataFrame:
    """(key, found, distance): the language whose profile is nearest to the text's, of equal ones the first by name; null for a
    text of less than ``least`` characters, without letters, or where there are no profiles. Whole texts are read."""
    known = profile_codes(profiles)
    schema = T.StructType([docs.schema[key]]).add("found", "string").add("distance", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for spaced, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mine = ranked_grams(*grams(spaced), ranks) if size >= least else ()
                best.append(min(((out_of_place(mine, p, ranks), k) for k, p in known.items()), default=(None, None)) if len(mine) else (None, None))
            distance, found = zip(*best, strict=True) if best else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(distance, pa.int64())], names=schema.names)

    return docs.select(key, letters(F.col(text)), F.coalesce(F.length(text), F.lit(0))).mapInArrow(run, schema)
