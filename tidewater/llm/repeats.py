"""Exact repeats of ``length`` symbols or more, by prefix-free parsing and the suffix arrays of its
dictionary and its parse. Symbols are the bytes of a text, or the hashes of its words.

Parsing. A rolling hash over ``k`` symbols is a trigger where it is the smallest (leftmost of equals)
of ``gap`` successive ones. From a trigger the next one is that of the ``gap`` positions after it, so
the phrases that follow a place depend on nothing before it. A window of ``length`` symbols has its
first trigger, and the whole phrase that starts there, inside: the anchor, known by all that windows of
this trigger share, which is that phrase and as much of the parse behind it as fits. Equal windows have
equal anchors at equal places. Successive windows that share their anchor are one row; the text under
them, the context, is the end of one phrase and the parse from the anchor on, as far as they reach.

Counting decides most rows, by partial sums: an anchor that occurs once repeats nothing; a context
that occurs twice or more repeats as a whole.

Ordering decides the rest: contexts of one anchor that differ somewhere, one occurrence of each. The
suffixes of what stands before the anchors are the dictionary's suffixes, ranked by prefix doubling;
what follows the anchors are the parse's suffixes, sorted with the lengths of common prefixes of
neighbours. A suffix of the corpus is a suffix of the dictionary and then one of the parse, so the
pairs of ranks give the corpus order, and a window repeats if a neighbour in that order agrees on
``length`` symbols (the dictionary's suffix and the range minimum over the parse's common prefixes).
Here symbols are compared, not fingerprints. Anchors share nothing, so they are dealt out to tasks,
``_GROUP`` contexts of an anchor at most, and only undecided parts of the corpus are ever ordered.

An anchor with more contexts (a passage that very many texts share, between different surroundings)
never comes together. Its windows are counted by partial sums: first ``_STRIP`` of them at a time,
by what all of them share and by what they cover, then those of undecided strips one by one.

Rows carry 64 bits of the anchor and 64 of the context, mixed block by block. Occurrences belong to
a row of the input by its id and 64 bits of id and text.

Edge cases: a null text is empty; texts shorter than ``length`` have no repeats; a text that occurs
in two rows repeats as a whole, also if both rows have the same id; a period shorter than the window
makes windows repeat within one text; very long texts are parsed in pieces, which only cuts rows;
null ids are ids like any other; an empty table gives no rows; further columns pass through
``remove_repeats`` whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from . import storage
from .shingles import mix64, run_hashes, text_bytes, word_hashes

_U = np.uint64
_BYTE = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = 24
#: Windows parsed at once, and symbols before anchors that are ordered at once.
_PIECE = 1 << 20
#: Contexts of an anchor that are ordered in one task.
_GROUP = 256
_STRIP = 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(rows, width)
    head = np.minimum.accumulate(padded, axis=1).reshape(-1)
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[: len(x) - width + 1], head[width - 1 : len(x)])


def trigger_shape(length: int) -> tuple[int, int]:
    """(k, gap): symbols of a trigger, and places of which one is a trigger. Two gaps and a trigger fit
    a window."""
    k = max(1, min(16, length // 8))
    return k, max(1, (length - k + 1) // 2)


def parse(symbols: np.ndarray, offsets: np.ndarray, length: int):
    """The parse of pieces of text that lie one after the other: piece, first and last window and
    anchor (relative to the piece), hash of what all windows of the anchor share, hash of the context."""
    k, gap = trigger_shape(length)
    n = len(symbols)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE[symbols] if symbols.dtype == np.uint8 else symbols) * power[:n], out=total[1:])
    hashes = mix64((total[k:] - total[:-k]) * inverse[: n - k + 1])
    place = _U((1 << _PLACE_BITS) - 1)
    trigger = (_sliding_min((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), gap) & place).astype(np.int64)
    starts = n - length + 1
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = piece[:starts] == piece[length - 1 :]
    anchor = trigger[:starts]
    heads = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:starts] != piece[: starts - 1]) | (inside[1:] != inside[:-1]))))
    tails = np.append(heads[1:], starts) - 1
    heads, tails = heads[inside[heads]], tails[inside[heads]]
    at = anchor[heads]
    shared = run_hashes(symbols, at, np.full(len(at), length - gap + 1), length)
    covered = tails - heads + length
    context = mix64(run_hashes(symbols, heads, covered, length + 1) ^ mix64((at - heads).astype(np.uint64)))
    owner = piece[heads]
    return owner, heads - offsets[owner], tails - offsets[owner], at - offsets[owner], shared, context


def _symbols(column, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(column)
    return word_hashes(raw, offsets, lower=False) if by_words else (raw, offsets)


_PARSED = "key long, unit byte, s int, e int, t int, anchor long, context long"
_SYMBOLS = "key long, unit byte, c int, s int, e int, t int, anchor long, n long, m long, symbols binary"
_FOUND = "key long, unit byte, s int, e int"


def _schema(id_type, rest: str) -> StructType:
    return StructType([StructField("id", id_type), *StructType.fromDDL(rest).fields])


def _same_row(a: DataFrame, b: DataFrame, *more: str):
    """Join condition: rows belong to the same row of the input, and agree on ``more``."""
    return reduce(lambda x, y: x & y, [a.id.eqNullSafe(b.id), *[a[c] == b[c] for c in ("key", *more)]])


def _parser(lengths: list[tuple[int, bool]]):
    """Arrow function over (id, key, text): the parse in each unit."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in storage.batch_slices(whole, "text", _PIECE):
                for unit, (length, by_words) in enumerate(lengths):
                    symbols, offsets = _symbols(batch.column(2), by_words)
                    pieces, where = [], []

                    def flush():
                        ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
                        owner, s, e, t, shared, context = parse(np.concatenate(pieces), ends, length)  # noqa: B023
                        rows, first = (np.array(x, np.int64) for x in zip(*where, strict=True))  # noqa: B023
                        row, first = rows[owner], first[owner]
                        ranges = [pa.array((x + first).astype(np.int32)) for x in (s, e, t)]
                        keys = [batch.column(c).take(pa.array(row)) for c in (0, 1)]  # noqa: B023
                        return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(row), unit, np.int8)), *ranges, pa.array(shared.view(np.int64)), pa.array(context.view(np.int64))], names=["id", "key", "unit", "s", "e", "t", "anchor", "context"])  # noqa: B023

                    held = 0
                    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
                        text = symbols[offsets[row] : offsets[row + 1]]
                        for at in range(0, len(text) - length + 1, _PIECE):
                            pieces.append(text[at : at + _PIECE + length - 1])
                            where.append((row, at))
                            held += len(pieces[-1])
                            if held >= _PIECE:
                                yield flush()
                                pieces, where, held = [], [], 0
                    if pieces:
                        yield flush()

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (64 bits of id and text) and text (never null)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("key"), "text")


def _counted(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose whole context repeats (id, key, unit, s, e), and one row of each context of the
    anchors that have several (with n, its occurrences, and m, the contexts of its anchor). Every
    aggregate stands alone and is written, so that the joins, whose keys may be hot, can be split."""
    place = [c for c in parsed.columns if c not in ("anchor", "context")]
    often = storage.materialize(parsed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeat-anchors")
    live = storage.materialize(parsed.join(often, "anchor"), "repeat-live")
    contexts = storage.materialize(live.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")), "repeat-contexts")
    several = storage.materialize(contexts.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "repeat-several")
    twice = storage.materialize(contexts.filter("n > 1").select("anchor", "context"), "repeat-twice")
    whole = live.join(twice, ["anchor", "context"]).select("id", "key", "unit", "s", "e")
    return whole, contexts.join(several, "anchor").select("one.*", "anchor", "n", "m")


def _with_symbols(rows: DataFrame, texts: DataFrame, lengths: list[tuple[int, bool]], id_type) -> DataFrame:
    """``rows`` of undecided contexts with the symbols under their windows, which start at ``c``."""
    wanted = rows.groupBy("id", "key").agg(F.collect_list(F.struct("unit", "s", "e", "t", "anchor", "n", "m")).alias("rows"))
    wanted = storage.materialize(wanted, "repeat-wanted")
    found = texts.join(wanted, _same_row(texts, wanted)).select(texts.id, texts.key, "text", "rows")
    schema = _schema(id_type, _SYMBOLS)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in storage.batch_slices(whole, "text", _PIECE):
                units = [_symbols(batch.column(2), by_words) for _, by_words in lengths]
                at, out = [], []
                for row, parts in enumerate(batch.column(3).to_pylist()):
                    for p in parts:
                        symbols, offsets = units[p["unit"]]
                        a, b = offsets[row] + p["s"], offsets[row] + p["e"] + lengths[p["unit"]][0]
                        at.append(row)
                        out.append((p["unit"], p["s"], p["s"], p["e"], p["t"], p["anchor"], p["n"], p["m"], symbols[a:b].tobytes()))
                if out:
                    types = [pa.int8(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary()]
                    keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], names=schema.names)

    return found.mapInArrow(run, schema)


def suffix_ranks(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of the dictionary, as ranks: of every suffix that starts at a place of
    ``symbols`` and has ``left`` of them to its end. Suffixes have the same rank only if they are equal.
    Prefix doubling: ranks by 2h symbols are those of pairs of ranks by h."""

    def ranked(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.uint64)

    if symbols.dtype == np.uint8:
        h = 8
        padded = np.concatenate((symbols, np.zeros(8, np.uint8)))
        block = np.ndarray((len(symbols),), ">u8", padded.data, strides=(1,)).astype(np.uint64)
        shown = np.minimum(left, 8)
        block &= ~_U(0) ^ np.array([(1 << (64 - 8 * int(x))) - 1 for x in range(9)], np.uint64)[shown]
        rank = ranked((ranked(block) << _U(4)) | shown.astype(np.uint64))
    else:
        h = 1
        rank = ranked(symbols) + _U(1)
        rank[left == 0] = 0
    longest, here = int(left.max(initial=0)), np.arange(len(left))
    while h < longest:
        rest = np.where(left >= h, rank[np.minimum(here + h, len(here) - 1)] + _U(1), _U(0))
        rank = ranked((rank << _U(32)) | rest)
        h *= 2
    return rank


def common_prefixes(suffixes: np.ndarray, size: int, held: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of the parse: order of the rows of ``suffixes`` (bytes; the first eight name the
    anchor), and minima over 1, 2, 4, ... successive lengths of common prefixes of neighbours, in symbols
    of ``size`` bytes, of which each row holds ``held``."""
    # a suffix that ends early is padded; it comes before those that go on with zeros
    order = np.argsort(held, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(suffixes[order]).view(f"S{suffixes.shape[1]}").ravel(), kind="stable")]
    rows, held = suffixes[order], held[order]
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    lcp = np.maximum(first - 8, 0) // size
    # rows of one anchor agree on symbols only as far as both have any
    minima = [np.minimum(lcp, np.minimum(held[1:], held[:-1]))]
    step = 1
    while 2 * step <= len(minima[0]):
        minima.append(np.minimum(minima[-1][:-step], minima[-1][step:]))
        step *= 2
    return order, minima


def repeated_windows(anchors: np.ndarray, symbols: list[np.ndarray], before: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the contexts repeat in another one: flags, ``windows`` of them for each context.
    ``before``: symbols before the anchor. All contexts of an anchor have to be there."""
    size = symbols[0].dtype.itemsize
    held = np.array([len(x) for x in symbols]) - before
    suffixes = np.zeros((len(symbols), 8 + int(held.max()) * size), np.uint8)
    suffixes[:, :8] = anchors.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i, x in enumerate(symbols):
        suffixes[i, 8 : 8 + held[i] * size] = x[before[i] :].view(np.uint8)
    order, minima = common_prefixes(suffixes, size, held)
    parse_rank = np.empty(len(order), np.uint64)
    parse_rank[order] = np.arange(len(order), dtype=np.uint64)
    # each context's symbols before the anchor, and one place for the empty suffix
    heads = np.concatenate([x[: b + 1] for x, b in zip(symbols, before.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(symbols)), before + 1)
    start = np.cumsum(before + 1) - before - 1
    inner = np.arange(len(heads)) - start[owner]
    left = before[owner] - inner
    dictionary_rank = suffix_ranks(heads, left)
    real = np.flatnonzero(inner < windows[owner])
    corpus = np.argsort((dictionary_rank[real] << _U(32)) | parse_rank[owner[real]])
    at = real[corpus]
    same = dictionary_rank[at[1:]] == dictionary_rank[at[:-1]]
    low, high = (parse_rank[owner[x]].astype(np.int64) for x in (at[:-1], at[1:]))
    pairs = np.flatnonzero(same)
    low, high = low[pairs], high[pairs]
    level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    agree = np.zeros(len(pairs), np.int64)
    for d in np.unique(level).tolist():
        i = np.flatnonzero(level == d)
        agree[i] = np.minimum(minima[d][low[i]], minima[d][high[i] - (1 << d)])
    hit = pairs[agree + left[at[pairs]] >= length]
    flags = np.zeros(len(heads), bool)
    flags[at[hit]] = True
    flags[at[hit + 1]] = True
    return flags[real]


def _ranges(flags: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last of the runs of set flags; ``counts`` flags for each owner, from ``first``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
    new = np.concatenate(([True], owner[1:] != owner[:-1]))
    heads = np.flatnonzero(flags & (new | ~np.concatenate(([False], flags[:-1]))))
    tails = np.flatnonzero(flags & np.concatenate((new[1:] | ~flags[1:], [True])))
    return owner[heads], first[owner[heads]] + inner[heads], first[owner[tails]] + inner[tails]


def _order_groups(contexts: DataFrame, lengths: list[tuple[int, bool]], id_type) -> DataFrame:
    """Windows that repeat among the contexts of their anchor, by the suffix arrays."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def flush(table):
            for unit, (length, by_words) in enumerate(lengths):
                part = table.filter(pc.equal(table["unit"], unit))
                if not part.num_rows:
                    continue
                s, e, t, anchor, n = (part[c].to_numpy().astype(np.int64) for c in ("s", "e", "t", "anchor", "n"))
                symbols = [np.frombuffer(x, np.uint64 if by_words else np.uint8) for x in part["symbols"].to_pylist()]
                flags = repeated_windows(anchor, symbols, t - s, e - s + 1, length)
                owner, first, last = _ranges(flags & np.repeat(n == 1, e - s + 1), s, e - s + 1)
                keys = [part[c].combine_chunks().take(pa.array(owner)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(owner), unit, np.int8)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["id", "key", "unit", "s", "e"])

        held, size = [], 0
        for batch in batches:
            # an anchor's rows lie together: the last one of the batch may go on in the next
            held.append(batch)
            size += batch.nbytes
            if size >= 4 * _PIECE:
                table = pa.Table.from_batches(held)
                anchors = table["anchor"].to_numpy()
                whole = int(np.argmax(anchors == anchors[-1]))
                if whole:
                    yield from flush(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks()
                held, size = rest.to_batches(), 0
        if held and sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held))

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _schema(id_type, _FOUND))


def _strips(contexts: DataFrame, lengths: list[tuple[int, bool]], width: int, id_type) -> DataFrame:
    """Windows ``s`` to ``e`` of each row of ``contexts``, ``width`` at a time as counted from the
    anchor. A strip's anchor is what all windows of a whole strip share, its context what its own cover."""

    schema = _schema(id_type, "key long, unit byte, c int, s int, e int, t int, anchor long, context long")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in storage.batch_slices(whole, "symbols", _PIECE):
                of_unit = batch.column(2).to_numpy()
                for unit, (length, by_words) in enumerate(lengths):
                    rows = np.flatnonzero(of_unit == unit)
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    c, s, e, t = (part.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5, 6))
                    each = [np.frombuffer(x, np.uint64 if by_words else np.uint8) for x in part.column(7).to_pylist()]
                    symbols, base = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1] - c
                    owner = np.repeat(np.arange(len(rows)), e - s + 1)
                    window = np.arange(len(owner)) - np.repeat(np.cumsum(e - s + 1) - (e - s + 1), e - s + 1) + s[owner]
                    strip = (t[owner] - window) // width
                    heads = np.flatnonzero(np.concatenate(([True], (strip[1:] != strip[:-1]) | (owner[1:] != owner[:-1]))))
                    first, last, strip, owner = window[heads], window[np.append(heads[1:], len(window)) - 1], strip[heads], owner[heads]
                    shared = run_hashes(symbols, base[owner] + t[owner] - strip * width, np.full(len(owner), length - width + 1), 2 * length + width)
                    covered = run_hashes(symbols, base[owner] + first, last + length - first, 2 * length + width + 1)
                    place = mix64((t[owner] - first).astype(np.uint64)) ^ (t[owner] - last).astype(np.uint64)
                    anchor, context = shared ^ mix64(strip.astype(np.uint64)), mix64(covered ^ place)
                    keys = [part.column(k).take(pa.array(owner)) for k in (0, 1, 2)]
                    ints = [pa.array(x.astype(np.int32)) for x in (c[owner], first, last, t[owner])]
                    yield pa.RecordBatch.from_arrays([*keys, *ints, pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))], names=schema.names)

    return contexts.select("id", "key", "unit", "c", "s", "e", "t", "symbols").mapInArrow(run, schema)


def _crowded(contexts: DataFrame, lengths: list[tuple[int, bool]], id_type) -> list[DataFrame]:
    """Windows that repeat among the contexts of anchors that have too many of them to be ordered."""
    found, rows = [], contexts
    for width in (min(_STRIP, max(1, min(n for n, _ in lengths) // 4)), 1):
        whole, undecided = _counted(storage.materialize(_strips(rows, lengths, width, id_type), "repeat-strips"))
        found.append(storage.materialize(whole, "repeat-ranges"))
        undecided = storage.materialize(undecided.select("id", "key", "unit", "c", "s", "e", "t"), "repeat-undecided")
        held = contexts.select("id", "key", "unit", "c", "symbols")
        rows = undecided.join(held, _same_row(undecided, held, "unit", "c")).select(*[undecided[x] for x in undecided.columns], "symbols")
    return found


def find_repeats(docs: DataFrame, *, length: int = 400, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, ranges (unit, s, e) of the windows that repeat, for every text that has any. Unit 0 has
    windows of ``length`` bytes; unit 1, with ``words``, windows of so many words."""
    lengths = [(length, False)] + [(words, True)] * bool(words)
    texts = keyed(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType
    shortest = F.octet_length("text") >= min(length, 2 * words - 1 if words else length)
    with storage.scratch(docs.sparkSession) as keep:
        with storage.scratch(docs.sparkSession) as pass_on:
            parsed = storage.materialize(texts.filter(shortest).mapInArrow(_parser(lengths), _schema(id_type, _PARSED)), "repeat-parse")
            whole, undecided = _counted(parsed)
            found = [pass_on(whole, "repeat-ranges")]
            contexts = pass_on(_with_symbols(undecided, texts, lengths, id_type), "repeat-symbols")
        found.append(storage.materialize(_order_groups(contexts.filter(F.col("m") <= _GROUP), lengths, id_type), "repeat-ranges"))
        crowded = contexts.filter(F.col("m") > _GROUP)
        if crowded.limit(1).count():
            found += _crowded(crowded, lengths, id_type)
        everything = reduce(DataFrame.unionByName, found)
        return keep(everything.groupBy("id", "key").agg(F.collect_list(F.struct("unit", "s", "e")).alias("ranges")), "repeat-spans")


def _spans(raw: bytes, ranges: list[dict], length: int, words: int) -> tuple[list[list[int]], list[list[int]]]:
    """Bytes that windows of ``length`` bytes cover, and those that any windows cover: disjoint runs."""
    mine = [(r["s"], r["e"] + length) for r in ranges if not r["unit"]]
    by_words = [r for r in ranges if r["unit"]]
    if by_words:
        at = [m.span() for m in _WORD.finditer(raw)]
        by_words = [(at[r["s"]][0], at[r["e"] + words - 1][1]) for r in by_words]

    def merged(spans):
        out: list[list[int]] = []
        for s, e in sorted(spans):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    return merged(mine), merged([*mine, *by_words])


def _without(raw: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut_repeats(docs: DataFrame, *, length: int = 400, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: row (a struct of all its columns but the text), n_bytes, n_removed,
    n_spans and kept_sha256 (by windows of ``length`` bytes), and text: what is left without the windows
    of ``words`` words as well, if asked for. Characters of which only a part repeats go from the text as
    a whole; a text without repeats, or null, stays as it is."""
    spans = find_repeats(docs, length=length, words=words, id_col=id_col, text_col=text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    packed = packed.withColumn("key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    joined = packed.join(spans, _same_row(packed, spans), "left").select("row", "text", "ranges")
    facts = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    schema = StructType([StructField("row", packed.schema["row"].dataType), *facts.fields])

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in storage.batch_slices(whole, "text"):
                out = []
                for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    mine, every = _spans(raw, ranges or [], length, words)
                    kept = _without(raw, mine)
                    left = text if not every else (kept if mine == every else _without(raw, every)).decode(errors="ignore")
                    out.append((len(raw), len(raw) - len(kept), len(mine), hashlib.sha256(kept).hexdigest(), left))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], names=schema.names)

    return joined.mapInArrow(run, schema)


def repeat_digests(docs: DataFrame, *, length: int = 400, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and text of every row, as in ``cut_repeats``."""
    cut = cut_repeats(docs, length=length, words=words, id_col=id_col, text_col=text_col)
    return cut.select(F.col("row").getField(id_col).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def remove_repeats(docs: DataFrame, *, length: int = 400, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated byte taken out of ``text_col``, those of passages of ``words`` words
    too, if asked for, however few bytes they have."""
    cut = cut_repeats(docs, length=length, words=words, id_col=id_col, text_col=text_col)
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are by windows of 400 bytes; the text is what the pipeline's stage leaves, without the
    passages of over 50 words that repeat."""
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=51)
