"""The registered queries over whole small tables, and the pipeline, against plain Python."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewater.llm import language, license as licenses, storage, url_filter

from .test_llm import WORD, crc, cut, encoded, linked, plain_licences, plain_measures, plain_prediction, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PIPELINE = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, benchmark and pages with copies, near copies, shared passages, benchmark text, licence lines,
    empty and null texts, and one long text."""
    rng, root = random.Random(17), tmp_path_factory.mktemp("sf")
    fresh = lambda n: words(rng.randrange(10**9), n, 10**6)
    base = [fresh(rng.randrange(60, 140)) for _ in range(14)]
    texts = [" ".join(b) for b in base]
    texts += texts[:3] + [" ".join(b[:50] + ["changed"] + b[51:]) for b in base[:4]]
    passage, short = fresh(60), fresh(45)
    texts += [" ".join(fresh(40) + passage + fresh(30)) for _ in range(4)] + [" ".join(fresh(50) + short + fresh(40)) for _ in range(3)]
    items = [(i, " ".join(fresh(30))) for i in range(5)] + [(5, None), (6, "two words")]
    texts += [" ".join(fresh(60)) + "\n" + items[i][1] + "\n" + " ".join(fresh(30)) for i in (0, 2)] + [" ".join(fresh(70) + items[1][1].split()[:20] + fresh(40))]
    texts += ["# Released under the MIT License.\n" + " ".join(fresh(60)), "a b c " * 40, "### $$ " * 90, "UPPER CASE " + " ".join(w.upper() for w in fresh(80)), "\n".join(["same line here"] * 6 + fresh(60))]
    texts += [None, "", " \n ", "one", " ".join(fresh(2600)), "ünï " * 60 + " ".join(fresh(60))]
    ids = rng.sample(range(1, 900), len(texts))
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    docs = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t, lang in zip(ids, texts, langs, strict=True)]
    pages = [(i, u, h) for i, (u, h) in enumerate([
        ("http://a.com/en/1", "<p>x"), ("https://example.com/en/7?q", "<p>x"), ("http://b.NET/de/4", None), ("http://example.net/de/81", ""), ("http://c.org/es/9", "é"), ("http://other.io/x", "<p>x"), (None, "y"), ("nothing", "z" * 3000), ("http://d.net/de/5", "w"), ("http://e.org/es/", "v"),
    ])]
    spark.createDataFrame(docs, DOCUMENTS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    storage.ship_package(spark)
    return str(root), docs, items, pages


@pytest.fixture
def run(spark, tables):
    return lambda name: entry.queries()[name](spark, tables[0])


def test_op1(run, tables):
    out = run("op1_minhash")
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect())) == linked([d[:2] for d in tables[1]], 3, 85)


def test_op2(run, tables):
    raw = {i: (h or "").encode() for i, _, h in tables[3]}
    first = {b: min(i for i, x in raw.items() if x == b) for b in raw.values()}
    expected = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if first[b] == i else ("revisit", first[b]))) for i, b in raw.items()]
    assert sorted(map(tuple, run("op2_warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == expected


def packed(rows, docs, max_len=2048):
    """Whether ``rows`` hold every id of ``docs`` once, gapless, in sequences that fit."""
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = encoded(text) + [1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, crc(ids[at : at + r.length]), len(ids))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_len
    tokens = sum(len(encoded(t)) + 1 for _, t in docs)
    assert len(sequences) <= -(-tokens // max_len) + 1


def test_op3(run, tables):
    packed(run("op3_packing").collect(), [d[:2] for d in tables[1]])


def test_op4(run, spark, tables):
    out = {r.doc_id: r for r in run("op4_language_id").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in tables[1]}
    learnt = spark.createDataFrame([d for d in tables[1] if not held[d[0]]], DOCUMENTS)
    profiles = language.train_profiles(learnt, lang_col="lang", text_col="text")
    for i, text, *_ in tables[1]:
        name, score = plain_prediction(text or "", profiles, language.PROFILE)
        assert (out[i].held_out, out[i].lang_pred, round(out[i].score, 9)) == (held[i], name, round(score, 9))


def contained(docs, items, k=5):
    found = set()
    for j, item in items:
        w = WORD.findall((item or "").lower())
        n = min(k, len(w))
        mine = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
        for i, text in docs:
            v = WORD.findall((text or "").lower())
            both = len(mine & {tuple(v[p : p + n]) for p in range(len(v) - n + 1)})
            if mine and 100 * both >= 80 * len(mine):
                found.add((i, j, len(mine), both))
    return found


def test_op5(run, tables):
    got = run("op5_decontamination").select("doc_id", "item_id", "item_shingles", "shared_shingles").collect()
    assert set(map(tuple, got)) == contained([d[:2] for d in tables[1]], tables[2]) and len(got) == 2


def test_op6(run, tables):
    rows = [d[:2] for d in tables[1]]
    got = run("op6_suffix_dedup")
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(e[:5] for e in cut(rows, 400))
    assert {r.doc_id: r.text for r in got.collect()} == without_repeats(rows)


def test_op7(run, tables):
    files = []
    for i, text, _, source, _ in tables[1]:
        files.append((i, f"{source}/{i // 1000}/{i // 100}/{f'LICENSE-{i}' if i % 100 < 20 else f'{i}.txt'}", text))
    got = sorted(((r.doc_id, r.license, r.origin) for r in run("op7_license").collect()), key=repr)
    assert got == sorted(((a, b, d) for a, b, _, d in plain_licences(files)), key=repr) and licenses.TEMPLATES
    assert any(b == "MIT" for _, b, _ in got)


def test_op8(run, tables):
    out, at = {r.doc_id: r for r in run("op8_token_binary").collect()}, 0
    for i, text, *_ in sorted(tables[1], key=lambda d: d[0]):
        ids = encoded(text) + [0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def judged(text):
    m = plain_measures(text)
    failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
    upper, lines = sum(c.isupper() for c in text or ""), sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    return m, failed, not (failed or 10 * m[2] > m[0] or not 3 * m[0] <= m[1] <= 10 * m[0] or 10 * upper > 3 * m[1] or 2 * m[3] > lines)


def test_op9(run, tables):
    for r in run("op9_quality_rules").collect():
        text = next(t for i, t, *_ in tables[1] if i == r.doc_id)
        assert ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) == judged(text)


def test_op10(run, tables):
    out = {r.page_id: r for r in run("op10_url_filter").collect()}
    assert set(out) == {i for i, *_ in tables[3]}
    for i, url, _ in tables[3]:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host, path = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best and best.text)
        assert out[i].verdict == best.verdict if best else out[i].verdict in ("allow", "block")


def without_repeats(rows):
    """Texts without the bytes of 400-byte windows and of 51-word windows that repeat."""
    raw = [(t or "").encode() for _, t in rows]
    at = [[(m.group(), m.span()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    seen = collections.Counter(b[p : p + 400] for b in raw for p in range(len(b) - 399))
    often = collections.Counter(tuple(x for x, _ in w[p : p + 51]) for w in at for p in range(len(w) - 50))
    out = {}
    for (i, text), b, w in zip(rows, raw, at, strict=True):
        mark = bytearray(len(b))
        spans = [(p, p + 400) for p in range(len(b) - 399) if seen[b[p : p + 400]] > 1]
        spans += [(w[p][1][0], w[p + 50][1][1]) for p in range(len(w) - 50) if often[tuple(x for x, _ in w[p : p + 51])] > 1]
        for s, e in spans:
            mark[s:e] = b"\1" * (e - s)
        out[i] = bytes(x for x, m in zip(b, mark, strict=True) if not m).decode(errors="ignore") if spans else text
    return out


def test_pipeline(spark, tables):
    """Every stage on what its predecessor kept, and the whole run."""
    root, docs, items, _ = tables
    rows = {d[0]: d for d in docs}
    expected = []
    rows = {i: d for i, d in rows.items() if judged(d[1])[2]}
    expected.append(dict(rows))
    rows = {i: rows[i] for i, _, _, kept in linked([d[:2] for d in rows.values()], 5, 80) if kept}
    expected.append(dict(rows))
    left = without_repeats([d[:2] for d in rows.values()])
    rows = {i: (i, left[i], *d[2:4], len(left[i])) for i, d in rows.items()}
    expected.append(dict(rows))
    bad = {i for i, *_ in contained([d[:2] for d in rows.values()], items)}
    rows = {i: d for i, d in rows.items() if i not in bad}
    expected.append(dict(rows))
    assert [len(docs), *map(len, expected)] == sorted([len(docs), *map(len, expected)], reverse=True) and bad and any(left[i] != dict((d[0], d[1]) for d in docs)[i] for i in left)
    frame = spark.read.parquet(f"{root}/documents.parquet")
    for (name, stage), kept in zip(PIPELINE.STAGES[:-1], expected, strict=True):
        frame = storage.materialize(stage(spark, frame, root), f"test-{name}")
        assert frame.schema.simpleString() == f"struct<{DOCUMENTS.replace('long', 'bigint').replace(', ', ',').replace(' ', ':')}>"
        assert {r.doc_id: tuple(r) for r in frame.collect()} == kept, name
    packed(PIPELINE.run(spark, root).collect(), [d[:2] for d in rows.values()])


def test_pipeline_of_odd_tables(spark, tables, tmp_path):
    """Empty tables, null ids, repeated rows and further columns go through all stages."""
    good = [" ".join(words(s, 80, 10**6)) for s in range(3)]
    rows = [(1, good[0], "en", "s", 1, "x", 2), (1, good[0], "en", "s", 1, "x", 2), (None, good[1], None, None, None, None, None), (2, None, "en", "s", 0, "y", 3), (3, "", "en", "s", 0, "y", 3), (4, good[2], "en", "s", 9, "z", 4)]
    docs = spark.createDataFrame(rows, f"{DOCUMENTS}, key string, kept long")
    for some, ids in ((docs, [None, 1, 4]), (docs.limit(0), [])):
        frame = some
        for name, stage in PIPELINE.STAGES[:-1]:
            frame = storage.materialize(stage(spark, frame, tables[0]), f"odd-{name}")
            assert frame.columns == docs.columns
        assert sorted((r.doc_id for r in frame.collect()), key=repr) == sorted(ids, key=repr)
        out = PIPELINE.STAGES[-1][1](spark, frame, tables[0])
        assert len({r.doc_id for r in out.collect()}) == len(ids)


def test_pipeline_removes_what_is_written(spark):
    before = spark.range(3)
    with storage.scratch(spark) as keep:
        storage.materialize(before, "gone")
        kept = keep(before, "stays")
    assert kept.count() == 3
    paths = list(storage._written[spark.sparkContext.applicationId])
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert not exists(next(p for p in reversed(paths) if "/gone-" in p)) and exists(next(p for p in reversed(paths) if "/stays-" in p))
    assert spark.range(1).select(F.lit(1)).count() == 1
