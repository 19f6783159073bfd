"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language (letters in lower case, one boundary
mark on each side of a word, never inside a gram), the most frequent first. A document is compared
by the out-of-place distance: for each of its own most frequent grams, how far its rank lies from
the rank in the profile, or the profile's length if it isn't there. The language with the smallest
distance wins (ties: the smaller name); the score is 1 minus the distance as a share of the largest
possible one.

Profiles are counted over all training texts: every task adds up its own counts before anything is
shuffled, and a gram's row carries a count, so a language that holds most of the corpus costs no
more than another. Profiles (``PROFILE`` rows a language) are all that the driver and the scoring
tasks hold.

Letters are code points (``str.isalpha``) of any plane, 21 bits each, so grams of all scripts are told
apart. Within a slice of texts the letters that occur are numbered in order, which keeps a gram and the
number of its text in one 64-bit key.

Edge cases: a null text, or one without letters, is ``und`` with score 0, as is every text if there
is nothing to learn from; grams of equal count rank by code; rows may repeat; a row with a null id
is never trained on and isn't held out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import storage

PROFILE = 400
_SLICE_BYTES, _SLICE_ROWS = 1 << 20, 2_000
#: Bits of a code point.
_POINT = 21
_table: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code point -> that of its lower-case letter, or 1 (boundary). Code 0 means no character."""
    if not _table:
        codes = np.ones(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                codes[cp] = ord(ch.lower()[0])
        _table.append(codes)
    return _table[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the text, gram) of every gram in one key, in no particular order; the code points that
    letters of a gram stand for, and the bits that each takes."""
    joined = "\n".join(["", *texts]) + "\n"
    points = _letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    there = np.zeros(0x110000, dtype=bool)
    there[points] = True
    alphabet = np.concatenate(([0], np.flatnonzero(there))).astype(np.uint64)  # 1 is always there
    width = int(len(alphabet)).bit_length()
    number = np.zeros(0x110000, dtype=np.uint32)
    number[alphabet.astype(np.int64)] = np.arange(len(alphabet), dtype=np.uint32)
    codes = number[points].astype(np.uint64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    if 3 * width + len(texts).bit_length() > 64:
        raise ValueError("too many texts for one call")
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths) << np.uint64(3 * width)
    a, b = codes[:-1], codes[1:]
    letter = a != 1
    one = (owner | a)[letter]
    pair = letter | (b != 1)
    bits = np.uint64(width)
    both = (a << bits) | b
    two = (owner | both)[pair]
    middle = letter[1:]
    three = (owner[:-1] | (both[:-1] << bits) | b[1:])[middle]
    return np.concatenate((one, two, three)), alphabet, width


def _global(gram: np.ndarray, alphabet: np.ndarray, width: int) -> np.ndarray:
    """Grams in code points, in the same order."""
    mask, out = np.uint64((1 << width) - 1), np.zeros(len(gram), dtype=np.uint64)
    for k in range(3):
        out |= alphabet[((gram >> np.uint64(k * width)) & mask).astype(np.int64)] << np.uint64(k * _POINT)
    return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.diff(np.append(heads, len(keys)))


def train_profiles(training: DataFrame, *, lang_col: str, text_col: str, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its grams, most frequent first. Rows without a language or text don't count."""

    def run(batches):
        import pyarrow as pa

        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in storage.batch_slices(whole, "text", _SLICE_BYTES):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    keys, alphabet, width = grams(["\n".join(texts)])
                    keys, counts = _counted(keys)
                    keys = _global(keys, alphabet, width)
                    if lang in totals:
                        keys, inverse = np.unique(np.concatenate((totals[lang][0], keys)), return_inverse=True)
                        counts = np.bincount(inverse, np.concatenate((totals[lang][1], counts))).astype(np.int64)
                    totals[lang] = keys, counts
        for lang, (keys, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    rows = training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in counts.withColumn("rank", rank).filter(F.col("rank") <= size).collect():
        profiles.setdefault(r.lang, []).append((r.rank, r.gram))
    return {lang: np.array([g for _, g in sorted(rows)], dtype=np.uint64) for lang, rows in sorted(profiles.items())}


def score_texts(texts: list[str], profiles: dict[str, np.ndarray], size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n, names = len(texts), list(profiles)
    keys, alphabet, width = grams(texts)
    keys, counts = _counted(keys)
    shift = np.uint64(3 * width)
    owner, gram = keys >> shift, keys & ((np.uint64(1) << shift) - np.uint64(1))
    # by text, then count from high to low, then gram (in whose order the keys are)
    if len(counts) and (counts.max() >= 1 << 22 or n > 1 << 11 or len(counts) >= 1 << 31):
        order = np.lexsort((-counts, owner))
    else:
        falling = np.uint64((1 << 22) - 1) - counts.astype(np.uint64)
        packed = np.sort((owner << np.uint64(53)) | (falling << np.uint64(31)) | np.arange(len(counts), dtype=np.uint64))
        order = (packed & np.uint64((1 << 31) - 1)).astype(np.int64)
    owner, gram = owner[order].astype(np.int64), gram[order]
    starts = np.searchsorted(owner, np.arange(n + 1))
    rank = np.arange(len(owner)) - starts[owner]
    top = rank < size
    owner, gram, rank = owner[top], _global(gram[top], alphabet, width), rank[top]
    used = np.bincount(owner, minlength=n)
    if not names:
        return ["und"] * n, np.zeros(n)
    distances = np.empty((len(names), n))
    for k, name in enumerate(names):
        by_gram = np.argsort(profiles[name])
        known = profiles[name][by_gram]
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        apart = np.where(known[at] == gram, np.minimum(np.abs(by_gram[at] - rank), size), size)
        distances[k] = np.bincount(owner, apart, minlength=n)
    best = distances.argmin(axis=0)
    score = np.where(used > 0, 1 - distances[best, np.arange(n)] / np.maximum(used * size, 1), 0.0)
    return [names[b] if u else "und" for b, u in zip(best, used, strict=True)], score


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, id_col: str, text_col: str, size: int = PROFILE) -> DataFrame:
    """``id_col``, lang_pred, score."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in storage.batch_slices(whole, "text", _SLICE_BYTES):
                for at in range(0, part.num_rows, _SLICE_ROWS):
                    batch = part.slice(at, _SLICE_ROWS)
                    names, score = score_texts([t or "" for t in batch.column(1).to_pylist()], profiles, size)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str):
    """One document in five, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    profiles = train_profiles(training, lang_col="lang", text_col="text")
    found = predict(docs, profiles, id_col="doc_id", text_col="text")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
