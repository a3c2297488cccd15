"""Operators against brute force, round trips and held-out accuracy, and on rows that are odd in every way."""

import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import catalog, hnsw, jaccard, katz, langid, media, mixing, packing, quality, records, spans, tokens
from graphloom.llm.common import held_out, read_whole, scratch, words_of, write_whole
from graphloom.llm.graphs import components

from .katz_brute import brute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, s int, h string, start string, n_removed int, row string, label int"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(40_000))
ODD = [
    (1, "One two three four five six. Seven eight nine ten eleven twelve. And so on it goes here.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \n\t ", "fr", "a"),
    (5, "One two three four five six. Seven eight nine ten eleven twelve. And so on it goes here.", "en", "b"),
    (6, LONG, "en", None),
    (7, "word", "en", "a"),
    (7, "word", "en", "a"),
    (None, "no id has this text at all", "en", "a"),
    (8, "été 漢字 \U0001f600 <|endoftext|> a b\r\nc  d", "fr", "c"),
    (9, "!!! 123 ...", None, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, "y", "z", 3, "r", 4) for r in ODD], SHAPE)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def count(text):
    return len(WORDS.findall(text or ""))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = c.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted(map(tuple, df.select(*expected.columns).collect())) == sorted(expected.fetchall())


def test_apportion_is_highest_quotients():
    rng = random.Random(1)
    for _ in range(50):
        claims = [rng.choice([0, 1, 2.5, 7, 7, 40, 333.3]) for _ in range(rng.randint(1, 8))]
        caps = [rng.randint(0, 60) for _ in claims]
        seats = rng.randint(0, 120)
        given = [0] * len(claims)
        for _ in range(seats):
            open_ = [i for i, c in enumerate(claims) if c > 0 and given[i] < caps[i]]
            if open_:
                given[max(open_, key=lambda i: (claims[i] / (2 * given[i] + 1), -i))] += 1
        assert sum(mixing.apportion(claims, seats, caps)) == sum(given)
        assert all(abs(a - b) <= 1 for a, b in zip(mixing.apportion(claims, seats, caps), given))


def test_targets():
    assert mixing.targets([100, 100], [5, 2]) == pytest.approx([1000 / 7, 400 / 7])
    assert mixing.targets([10, 1000, 0], [5, 2, 1]) == pytest.approx([30, 980, 0])


def brute_mix(docs, block, shard_words, weights=(5, 2, 1), cap=3, seed=17):
    """docs: (doc_id, text, source, hash of text, shard number modulo n). One word at a time."""
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(count(d[1]) for d in docs if d[2] == s) for s in sources]
    target = mixing.targets(sizes, [weights[i % 3] for i in range(len(sources))], cap)

    def highest(claims, seats, caps):
        given = [0] * len(claims)
        for _ in range(seats):
            open_ = [i for i, c in enumerate(claims) if c > 0 and given[i] < caps[i]]
            if open_:
                given[max(open_, key=lambda i: (Fraction(claims[i]) / (2 * given[i] + 1), -i))] += 1
        return given

    seats = highest(target, round(sum(target) / block), [cap * n // block for n in sizes])
    out = []
    for i, s in enumerate(sources):
        n_shards = max(1, math.ceil(sizes[i] / shard_words))
        shards = [sorted((d for d in docs if d[2] == s and d[4] % n_shards == k), key=lambda d: (d[0] is not None, d[0] or 0, d[3])) for k in range(n_shards)]
        there = [k for k in range(n_shards) if shards[k]]
        words = {k: sum(count(d[1]) for d in shards[k]) for k in there}
        quota = dict(zip(there, (block * n for n in highest([words[k] for k in there], seats[i], [cap * words[k] // block for k in there]))))
        for k in there:
            over = round(target[i]) - sum(quota.values())
            quota[k] += min(over, cap * words[k] - quota[k]) if over > 0 else -min(-over, quota[k])
        for k in there:
            often = [quota[k] // words[k] if words[k] else 0] * words[k]
            left = quota[k] % words[k] if words[k] else 0
            for b in np.random.default_rng([seed, i, k]).permutation(-(-words[k] // block)) if left else ():
                for w in range(b * block, min((b + 1) * block, words[k])):
                    if left:
                        often[w], left = often[w] + 1, left - 1
            at = 0
            for d in shards[k]:
                n = count(d[1])
                out.append((d[0], n, sizes[i], target[i], sum(often[at : at + n])))
                at += n
    return out


@pytest.mark.parametrize("table, block, shard_words", [("docs", 2048, 1 << 20), ("docs", 100, 3000), ("odd", 7, 11)])
def test_mix(request, table, block, shard_words):
    df = request.getfixturevalue(table)
    mixed = mixing.mix(df, block_words=block, shard_words=shard_words, shards_a_group=1 << 20)
    rows = sorted(map(tuple, mixed.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    given = [tuple(r) for r in df.select("doc_id", "text", "source", F.xxhash64("text"), F.xxhash64("doc_id", F.xxhash64("text"))).collect()]
    assert rows == sorted(brute_mix(given, block, shard_words), key=str)
    grouped = mixing.mix(df, block_words=block, shard_words=shard_words, shards_a_group=3).collect()
    for source in {r[2] for r in given}:
        own = [r for r in grouped if r["source_size"] == sum(count(g[1]) for g in given if g[2] == source)]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    by_target = {}
    for r in grouped:
        by_target[r["source_size"], r["target"]] = by_target.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert all(taken % round(t) == 0 if round(t) else not taken for (_, t), taken in by_target.items())


def test_mixed_texts(docs, odd, none):
    for df in (docs, odd):
        taken = sum(r["taken"] for r in mixing.mix(df).collect())
        out = mixing.mixed_texts(df)
        assert out.columns == df.columns
        assert sum(count(r["text"]) for r in out.collect()) == taken
    assert mixing.mix(none).count() == mixing.mixed_texts(none).count() == 0


def test_tokens_equal_whole_texts(docs):
    encoder = tokens.Encoder.of(tokens.default_path())
    texts = [r[1] for r in ODD] + [" a", "a ", "a  b", "a\n\nb", "\n", "a \nb", "I'm they'll", "a b", "x" * 5000] + [r["text"] for r in docs.limit(60).collect()]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        at += n


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_pack(request, table):
    df = request.getfixturevalue(table)
    encoder = tokens.Encoder.of(tokens.default_path())
    expected = Counter()
    for r in df.collect():
        ids = [*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 2048):
            part = np.asarray(ids[i : i + 2048], "<u4")
            expected[r["doc_id"], i, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    rows = packing.pack(df).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by) <= total / 2048 * 1.1 + 2


def test_best_fit_is_tightest():
    rng = random.Random(4)
    lengths = np.asarray([rng.randint(1, 64) for _ in range(400)])
    window, offset, n = packing.best_fit(lengths, 64)
    left, brute_window = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [(c, w) for w, c in enumerate(left) if c >= lengths[i]]
        w = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(64)
        left[w] -= lengths[i]
        brute_window[i] = w
    assert n == len(left) and sorted(left) == sorted(64 - np.bincount(window, weights=lengths))


def test_sequences(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 300))) for i in range(6)], "doc_id bigint, text string")
    packed = packing.pack(df)
    got = packing.sequences(df, packed).collect()
    assert {len(r["ids"]) for r in got} <= {2048, *(1 << i for i in range(11))} and len(got[0]["ids"])
    assert {r["padded"] for r in packed.collect()} == {len(r["ids"]) for r in got}
    assert sum(i != 0 for r in got for i in r["ids"]) == sum(r["length"] for r in packed.collect())


def test_sequences_are_padded_but_at_powers_of_two(spark):
    encoder = tokens.Encoder.of(tokens.default_path())
    length = lambda text: len(encoder.tokenizer.encode(text, add_special_tokens=False).ids) + 1
    texts = [" ".join(["a"] * n) for n in range(1, 40)]
    for text in texts:
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string") if length(text) in (8, 9, 16, 32) else None
        if df is not None:
            (row,) = packing.sequences(df, packing.pack(df)).collect()
            assert len(row["ids"]) == (length(text) if length(text) != 9 else 2048)
    assert packing.padded_length(np.asarray([1, 2, 3, 1024, 1025, 2048]), 2048).tolist() == [1, 2, 2048, 1024, 2048, 2048]


def test_sequences_of_rows_that_share_doc_ids(docs, odd):
    encoder = tokens.Encoder.of(tokens.default_path())
    mixed = mixing.mixed_texts(docs).select("doc_id", "text")
    assert mixed.count() > mixed.select("doc_id").distinct().count()
    long = " ".join(f"w{i}" for i in range(1500))
    more = [(1, long), (1, long), (1, long + " x"), (None, long), (None, "other"), (None, None), (2, None), (2, "")]
    for df in (mixed, odd.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id bigint, text string"))):
        df, want = df.cache(), Counter()
        for r in df.collect():
            ids = [*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.update((r["doc_id"], i, tuple(ids[i : i + 2048])) for i in range(0, len(ids), 2048))
        packed = packing.pack(df)
        got = {r["sequence_id"]: r["ids"] for r in packing.sequences(df, packed).collect()}
        assert all(len(ids) == 2048 or len(ids) & (len(ids) - 1) == 0 for ids in got.values())
        found, used = Counter(), Counter()
        for r in packed.collect():
            found[r["doc_id"], r["start"], tuple(got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]])] += 1
            used[r["sequence_id"]] += r["length"]
        assert found == want and used.keys() == got.keys()
        assert all(not any(ids[used[s] :]) for s, ids in got.items())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_records(spark, request, table):
    df = request.getfixturevalue(table)
    encoder = tokens.Encoder.of(tokens.default_path())
    expected, start = [], 0
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = np.asarray([*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    files = records.write_records(df, scratch(spark, "test-records"))
    assert sorted(map(tuple, records.read_records(spark, files).collect()), key=lambda r: r[1]) == expected
    assert records.read_records(spark, records.write_records(df.limit(0), scratch(spark, "test-records"))).count() == 0
    last = records.read_record(files[-1]["path"], [files[-1]["records"] - 1])[0]
    assert last[0] == expected[-1][0] and len(last[1]) == expected[-1][2]


def test_records_in_a_stream():
    payloads = [bytes([i]) * n for i, n in enumerate([0, 1, 50, 3, 1000])]
    data = b"".join(map(records.frame, payloads))
    for size in (1, 7, 64, 5000):
        assert [bytes(p) for p in records.records_of(data[i : i + size] for i in range(0, len(data), size))] == payloads
    with pytest.raises(records.Truncated):
        list(records.records_of([data[:-1]]))


def test_damage_is_seen(spark):
    uri = scratch(spark, "test-damage") + "/x"
    data = bytearray(records.frame(b"some payload"))
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)
    write_whole(uri, data)
    assert read_whole(uri) == data


def test_katz_chunks_are_lean(monkeypatch):
    """Two chunks of 8 MB: what Python and numpy hold at once, in bytes for each byte of a chunk."""
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 1000) % 100_000) for _ in range(5000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5000)), "held_out": pa.array([False] * 5000), "text": pa.array(texts)})
    batches = [batch.slice(i, 1000) for i in range(0, 5000, 1000)]
    tracemalloc.start()
    try:
        tokens = sum(int(katz._unpack(p)[3].sum()) for b in katz._chunks(4, np.zeros(0, np.uint64))(batches) for k, p in zip(b["kind"].to_pylist(), b["payload"].to_pylist()) if k == katz._KINDS["docs"])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tokens == 5000 * 1001 and sum(map(len, texts)) > 16 << 20
    assert most / (8 << 20) < 10


def test_spans(spark):
    passage = "The first one is here for us. The second one is there for you. The third one is nowhere at all."
    rows = [(1, f"Alpha opens this text. {passage} Alpha closes it."), (2, f"Beta opens. {passage.upper()}\nBeta closes."), (3, "Nothing here is like the others. Not at all. No."), (0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in spans.dedup(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[0]["text"] is None
    assert got[2]["text"] == "Beta opens.Beta closes."
    assert got[2]["n_removed"] == 3 and got[2]["n_chars"] == len(got[2]["text"])
    assert {r["doc_id"]: r["n_removed"] for r in spans.dedup(df, span=4).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    with pytest.raises(ValueError):
        spans.dedup(df, span=1)


@pytest.mark.parametrize("n", [1, 2, 3, 30])
def test_spans_of_sentences_of_any_length(spark, n):
    for end in (". ", "\n"):
        k = max(3, -(-54 // n))
        passage = "".join(" ".join(f"p{i}x{j}" for j in range(n)) + end for i in range(k))
        rows = [(1, f"Alpha opens this text.{end}{passage}Alpha closes it."), (2, f"Beta begins here.{end}{passage.upper()}Beta ends there.")]
        got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
        assert got[2]["text"] == f"Beta begins here.{end}Beta ends there." and got[2]["n_removed"] == k


def runs_left(rows, n):
    """Brute force: without any repeat of n words but its first, one whose words overlap the first from there on."""
    first, gone = {}, {i: set() for i, _ in rows}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = {i: [m for m in word.finditer(t or "")] for i, t in rows}
    for i, _ in sorted(rows):
        lower = [m.group().lower() for m in words[i]]
        for k in range(len(lower) - n + 1):
            doc, at = first.setdefault(tuple(lower[k : k + n]), (i, k))
            if (doc, at) != (i, k):
                gone[i] |= set(range(max(k, at + n) if doc == i else k, k + n))
    kept = {}
    for i, t in rows:
        starts = [m.start() for m in words[i]] + [len(t or "")]
        kept[i] = t and t[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(words[i])) if k not in gone[i])
    return kept


@pytest.mark.parametrize("n", [2, 7, 16, 50])
def test_runs_of_words(spark, n):
    rng = np.random.default_rng(n)
    draw = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    passages = [draw(n + int(k)) for k in rng.integers(0, 12, 6)] + [draw(n - 1), ["heat"] * (n + 9), draw(3) * n]
    rows = []
    for i in range(60):
        words = draw(int(rng.integers(0, 9)))
        for k in rng.integers(0, len(passages), int(rng.integers(0, 4))):
            words += [w.upper() if rng.random() < 0.2 else w for w in passages[k]] + draw(int(rng.integers(0, 9)))
        rows.append((i, "".join(w + str(rng.choice([" ", "  ", " \t"])) for w in words)))
    rows += [(60, None), (61, ""), (62, " ".join(draw(n - 1)))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = dict(spans.dedup(table, span=1000, words=n).select("doc_id", "text").collect())
    assert got == runs_left(rows, n)


def test_passages_that_cross_sentences(spark):
    passage = " ".join(f"p{i}" + "." * (i in (9, 30)) for i in range(51))  # one whole sentence, and parts of two
    rows = [(1, f"Alpha opens {passage} then alpha closes."), (2, f"Beta begins {passage} while beta ends."), (3, f"Gamma {passage.upper()[3:]}")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    assert {r["text"] for r in spans.dedup(table).collect()} == {t for _, t in rows}
    got = {r["doc_id"]: r for r in spans.dedup(table, words=spans.WORDS).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == [rows[0][1], "Beta begins while beta ends.", "Gamma "]
    assert [got[i]["n_removed"] for i in (1, 2)] == [0, 3] and got[2]["n_chars"] == len(got[2]["text"])
    odd = table.withColumns({"a b": F.lit(1), "x.y:z<w>": F.lit("p"), "did": F.lit(2), "marks": F.lit(3)})
    again = spans.dedup(odd, words=spans.WORDS).collect()
    assert {r["text"] for r in again} == {r["text"] for r in got.values()} and all(tuple(r)[3:7] == (1, "p", 2, 3) for r in again)
    with pytest.raises(ValueError):
        spans.dedup(table, words=1)


@pytest.mark.parametrize("words", [0, 50])
def test_hits_are_merged_at_every_size(spark, words):
    passage = "The first one is here for us. The second one is there for you. The third one is nowhere at all."
    table = spark.createDataFrame([(1, f"Alpha. {passage}"), (2, f"Beta. {passage}"), (3, None)], "doc_id bigint, text string")
    left = spans.dedup(table, words=words)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r["doc_id"]: r["n_removed"] for r in left.collect()} == {1: 0, 2: 3, 3: 0}


def test_spans_within_a_text_and_without_spaces(spark):
    passage = "春天来了。花都开了！鸟儿在唱歌。我们去山上看花吧？"
    rows = [(1, f"第一篇的开头。{passage}第一篇的结尾。"), (2, f"另一篇由此开始。{passage}另一篇到此为止。"), (3, "A b.\nC d.\nE f.\nA b.\nC d.\nE f.\n")]
    got = {r["doc_id"]: r["text"] for r in spans.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "另一篇由此开始。另一篇到此为止。", 3: "A b.\nC d.\nE f.\n"}


def test_media_against_plain_means(docs):
    """The stored bytes' digest, and the feature's numbers from the payload itself: byte b is the level of a block."""
    import hashlib

    stored = media.store(docs.limit(40))
    kept = {r["doc_id"]: bytes(r["media"]) for r in stored.select("doc_id", "media").collect()}
    for r in media.read_back(stored).collect():
        assert r["media_bytes"] == len(kept[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(kept[r["doc_id"]]).hexdigest()
        assert kept[r["doc_id"]][:4] == b"RIFF" and struct.unpack("<I", kept[r["doc_id"]][4:8])[0] == len(kept[r["doc_id"]]) - 8


def test_media_round_trip(spark, docs, odd):
    import hashlib

    for df in (docs, odd):
        stored = media.store(df)
        want = Counter()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            full = raw + bytes(-len(raw) % 64 if raw else 64)
            want[r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
        assert Counter(tuple(r)[:5] for r in media.read_back(stored).collect()) == want
    assert media.clips(stored).filter("clip = 0").count() == len(ODD)
    bad = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None), (3, bytearray(b"RIFF\x04\0\0\0AVI "))], "doc_id bigint, media binary")
    assert media.clips(bad).count() == 0


def _jpeg(coefficients, pattern, quant, parts, width, height, restart):
    """A plain encoder for any coefficients, with 4-bit and 8-bit codes."""
    ac_symbols = [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    tables = {"dc": ([0] * 3 + [12] + [0] * 12, list(range(12))), "ac": ([0] * 7 + [len(ac_symbols)] + [0] * 8, ac_symbols)}
    code = {k: media.huffman(*t) for k, t in tables.items()}
    put = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    show = lambda k, s: format(code[k][s][0], f"0{code[k][s][1]}b")
    streams, bits, before = [], "", [0] * 3
    for i, block in enumerate(coefficients):
        if restart and i and i % (restart * len(pattern)) == 0:
            streams, bits, before = [*streams, bits], "", [0] * 3
        c = pattern[i % len(pattern)]
        d, before[c] = block[0] - before[c], block[0]
        bits += show("dc", abs(d).bit_length()) + put(d)
        run = 0
        for v in block[1:]:
            if v:
                while run > 15:
                    bits, run = bits + show("ac", 0xF0), run - 16
                bits += show("ac", run << 4 | abs(v).bit_length()) + put(v)
                run = 0
            else:
                run += 1
        bits += show("ac", 0) if run else ""
    body = b""
    for n, s in enumerate([*streams, bits]):
        s += "1" * (-len(s) % 8)
        raw = bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")
        body += raw + (bytes([0xFF, 0xD0 + n % 8]) if n < len(streams) else b"\xff\xd9")
    seg = media._segment
    sof = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, p[0] << 4 | p[1], 0]) for i, p in enumerate(parts))
    sos = bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0])
    dht = b"".join(seg(0xC4, bytes([k, *t[0], *t[1]])) for k, t in ((0, tables["dc"]), (16, tables["ac"])))
    return b"\xff\xd8" + seg(0xDB, bytes([0, *quant])) + seg(0xC0, sof) + dht + seg(0xDD, struct.pack(">H", restart)) + seg(0xDA, sos) + body


@pytest.mark.parametrize("parts, pattern, restart", [([(1, 1)], [0], 0), ([(1, 1)], [0], 2), ([(2, 2), (1, 1), (1, 1)], [0, 0, 0, 0, 1, 2], 1)])
def test_frames_with_all_coefficients(parts, pattern, restart):
    rng = np.random.default_rng(3)
    wide = 8 * parts[0][0]
    across, down = 3, 2
    blocks = rng.integers(-40, 41, (across * down * len(pattern), 64)) * (rng.random((across * down * len(pattern), 64)) < 0.2)
    quant = rng.integers(1, 9, 64).tolist()
    jpeg = _jpeg(blocks.tolist(), pattern, quant, parts, across * wide, down * wide, restart)
    (pixels,) = media.decode_pixels([jpeg])
    x = np.arange(8)
    for u in range(across * down):
        for b in range(pattern.count(0)):
            own = np.zeros(64)
            own[media.ZIGZAG] = blocks[u * len(pattern) + b] * np.asarray(quant)
            own = own.reshape(8, 8)
            c = np.where(x == 0, math.sqrt(0.5), 1)
            cos = np.cos((2 * x[:, None] + 1) * x[None] * math.pi / 16) * c
            want = np.clip(np.rint(cos @ own @ cos.T / 4) + 128, 0, 255)
            k = parts[0][0]
            top, left = (u // across) * wide + 8 * (b // k), (u % across) * wide + 8 * (b % k)
            assert np.abs(pixels[top : top + 8, left : left + 8].astype(int) - want).max() <= 1


def test_typical_tables(spark):
    """Against the tables that Java has of the same standard, and canonical: each code leaves the last one of ones free."""
    java = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for mine, theirs in ((media.TYPICAL_DC, (java.StdDCLuminance, java.StdDCChrominance)), (media.TYPICAL_AC, (java.StdACLuminance, java.StdACChrominance))):
        for i in (0, 1):
            counts, symbols = list(theirs[i].getLengths()), list(theirs[i].getValues())
            assert mine[i] == (counts + [0] * (16 - len(counts)), symbols)


def _avi(frames, more=(), index=True):
    """A plain AVI file: a segment with ``frames`` and an AVIX segment with ``more``."""
    body, at, rows = b"", 4, []
    for j in frames:
        rows.append(struct.pack("<4sIII", b"00dc", 16, at, len(j)))
        body += media._chunk(b"00dc", j)
        at = 4 + len(body)
    head = media._list(b"hdrl", media._chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13)))
    first = media._chunk(b"RIFF", b"AVI " + head + media._list(b"movi", body) + (media._chunk(b"idx1", b"".join(rows)) if index else b""))
    return first + (media._chunk(b"RIFF", b"AVIX" + media._list(b"movi", b"".join(media._chunk(b"00dc", j) for j in more))) if more else b"")


def test_clips_of_files_of_others(spark):
    """Frames without Huffman tables, dropped and damaged frames, further segments, and files that cannot be read."""
    def frame(level, tables=None):
        tables = tables or (media.TYPICAL_DC[0], media.TYPICAL_AC[0])
        dc, ac = media.huffman(*tables[0]), media.huffman(*tables[1])
        d = level - 128
        n = abs(d).bit_length()
        show = lambda c: format(c[0], f"0{c[1]}b")
        bits = show(dc[n]) + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + show(ac[0]) + (show(dc[0]) + show(ac[0])) * 3
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        seg = media._segment
        return b"\xff\xd8" + seg(0xDB, bytes([0, 8] + [1] * 63)) + seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 1) + bytes([1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + raw + b"\xff\xd9"

    dark, light, bad = frame(10), frame(200), frame(10)[:40]
    files = {
        1: _avi([dark] * 5 + [light] * 3),
        2: _avi([b"", dark, b"", dark, dark, light, b"", light]),
        3: _avi([dark, bad, dark, dark, dark, light, light, light]),
        4: _avi([dark] * 5, [light] * 3),
        5: _avi([dark] * 5, [light] * 3, index=False),
        6: _avi([bad, b""]),
        7: _avi([]),
        8: b"RIFF",
        9: None,
    }
    table = spark.createDataFrame([(k, v, 7, "x") for k, v in files.items()], "doc_id bigint, media binary, clip int, `a b.c:d` string")
    got = media.clips(table, errors=True)
    assert got.columns == ["doc_id", "a b.c:d", "clip", "first_frame", "last_frame", "start_s", "end_s", "level", "damaged", "error"]
    rows = [tuple(r) for r in got.orderBy("doc_id", "clip").collect()]
    assert [r for r in rows if r[0] <= 5] == [(i, "x", *c, int(i == 3 and c[0] == 0), None) for i in range(1, 6) for c in ((0, 0, 5, 0.0, 0.2, 10.0), (1, 5, 8, 0.2, 0.32, 200.0))]
    assert [(r[0], r[2], bool(r[-1])) for r in rows if r[0] > 5] == [(i, None, True) for i in (6, 7, 8)]
    plain = media.clips(table.select("media"))
    assert plain.count() == 10 and "error" not in plain.columns


def test_columns_of_any_name(spark):
    text = "One two three four five six. Seven eight nine ten eleven twelve. And so on it goes here."
    rows = [(1, text, "a", 1, "p", 2), (2, text, "b", 3, "q", 4), (3, "other words", "a", 5, "r", 6), (4, None, "a", 7, "s", 8)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `a b` int, `x.y:z<w>` string, __id int")
    assert sorted(tuple(r) for r in jaccard.keep_one(table).collect()) == [rows[0], *rows[2:]]
    assert [tuple(r)[:6] for r in spans.dedup(table).orderBy("doc_id").collect()] == [rows[0], (2, "", *rows[1][2:]), *rows[2:]]
    mixed = mixing.mixed_texts(table)
    assert mixed.columns == table.columns and {r["__id"] for r in mixed.collect()} <= {2, 4, 6}


def test_shots():
    dark, light = np.full((4, 64), 10, np.uint8), np.full((4, 64), 200, np.uint8)
    assert media.shots([dark] * 5 + [light] * 3) == [(0, 5), (5, 8)] and media.shots([dark]) == [(0, 1)] and media.shots([]) == []


@pytest.mark.parametrize("table, hot_words", [("docs", 256), ("docs", 0), ("odd", 5)])
def test_katz(request, table, hot_words):
    df = request.getfixturevalue(table).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", held_out(remainder=1).alias("held_out"))
    want, (single, after, uni, prob) = brute([tuple(r) for r in df.collect()])
    got = {r["doc_id"]: r for r in katz.score(df, hot_words=hot_words).collect()}
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)
    assert sum(map(uni, single)) + uni("\0") == pytest.approx(1)
    for h in list(after)[:20]:
        assert sum(prob(h, w) for w in single) + prob(h, "\0") == pytest.approx(1)


def test_katz_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", held_out(remainder=1).alias("held_out"))
    base, score = katz.score(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def _sets(rows):
    out = []
    for _, text in rows:
        w = [x.lower() for x in WORDS.findall(text or "")]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_jaccard_loses_no_link(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 6, 9, 30, 80, 250, 700]))
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)]
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " ")]
    sets = _sets(rows)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(least.get(x, d), d)
    want = {d: (len(s), least[x]) for (d, _), s, x in zip(rows, sets, label)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(df).collect()}
    assert got == want
    assert len({x for _, x in want.values()}) < len(rows) - 20
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(df).collect())
    assert kept == sorted(d for d, (n, c) in want.items() if d == c)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, 150).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (jaccard.folded(jaccard.bitmap(s, w), 256) for s, w in ((a, 256), (b, 512)))
        assert jaccard.bound(x, len(a), y, len(b)) >= len(np.intersect1d(a, b))
    assert jaccard.linked(4, 5, 4, Fraction(4, 5)) and not jaccard.linked(4, 5, 5, Fraction(4, 5))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90}


@pytest.mark.parametrize("kind", ["random", "reversed", "smallest at the high end"])
def test_components_of_long_chains(spark, kind):
    n, rng = 1000, random.Random(9)
    ids = {"random": [rng.getrandbits(64) - (1 << 63) for _ in range(n)], "reversed": list(range(n, 0, -1)), "smallest at the high end": [*range(1, n), 0]}[kind]
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    assert {r["node"]: r["label"] for r in components(chain).collect()} == dict.fromkeys(ids, min(ids))


def test_nearest_recall_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(40)]
    rows += [(7000, None), (7100, []), (7200, [0.0] * 24), (7300, [float("nan")] * 24), (7400, [1.0, None]), (None, x[1].tolist()), (8000, [1.0, 2.0]), (8100, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=700).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.asarray(v, np.float32) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    for q in (i for i in usable if i % 100 == 0):
        near = sorted((math.sqrt(float(np.cumsum((usable[q].astype(float) - v.astype(float)) ** 2)[-1])), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
        found = sorted(got.get(q, []))
        assert [r for r, _, _ in found] == list(range(1, len(near) + 1))
        assert all(abs(s - hnsw.exact_distance(usable[q], usable[i])) == 0 for _, i, s in found)
        hit, total = hit + len({i for _, i in near} & {i for _, i, _ in found}), total + len(near)
    assert hit / total >= 0.97
    assert [i for _, i, _ in sorted(got[0])] == [5000 + i for i in range(10)]
    assert [i for _, i, _ in got[8000]] == [8100]
    assert hnsw.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_of_far_and_repeated_rows(spark):
    """Squares that overflow a double; a vec_id that asks twice alike, and one with two vectors."""
    rows = [(i, [float(i % 7), 1e200 * (i + 1)]) for i in range(40)]
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 5).collect()}
    assert len(got) == 10 and {i for i, _ in got.values()} <= set(range(41)) - {5} and got[1] == (4, pytest.approx(1e200)) and got[2] == (6, pytest.approx(1e200))
    small = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [3.2, 1.0])] * 2 + [(200, [3.2, 1.0]), (200, [20.4, 1.0])]
    found = hnsw.nearest(spark.createDataFrame(small, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 100 == 0, k=3).collect()
    answers = {}
    for r in found:
        answers.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(answers[100]) == [(1, 200), (2, 3), (3, 4)]
    assert sorted(answers[200]) == sorted([(1, 100), (2, 100), (3, 3), (1, 20), (2, 21), (3, 19)])


def test_nearest_by_cells(spark):
    """Clustered vectors in many cells: few are visited, and little is lost."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(30, 16))
    x = (middle[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    hit = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=200).collect():
        hit.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist()) for q in range(0, 3000, 100)}
    assert sum(len(hit[q] & want[q]) for q in want) / 300 >= 0.95


def test_graph_is_searchable_and_flat():
    x = np.random.default_rng(3).normal(size=(1500, 12)).astype(np.float32)
    graph = hnsw.build(x, 8, 32)
    assert [len(n) for n in graph["nodes"]] == sorted((len(n) for n in graph["nodes"]), reverse=True) and len(graph["nodes"][0]) == 1500
    assert all(r.shape == (len(n), 16 if i == 0 else 8) and set(r[r >= 0].tolist()) <= set(n.tolist()) for i, (n, r) in enumerate(zip(graph["nodes"], graph["links"])))
    ids, _ = hnsw.search(x, graph, x[:100], 1, 40)
    assert (ids == np.arange(100)[:, None]).any(1).mean() >= 0.98


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs.filter(~held_out()), per_label=200)
    test = docs.filter(held_out())
    right = langid.identify(test, net).join(test.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    rows = langid.identify(odd, net).collect()
    assert len(rows) == len(ODD) and {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4, 9} and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.fit(none) is None and langid.identify(none, net).count() == 0 and langid.identify(odd, None).filter("lang_pred != 'und'").count() == 0


def test_network_against_a_plain_pass():
    """Responses, softmax and the gradient, filter by filter and byte by byte."""
    rng = np.random.default_rng(1)
    net = langid.Network.fresh(["a", "b", "c"], 4)
    x = rng.integers(0, 256, (3, 20)).astype(np.uint8)
    h, _ = net.responses(x)
    for i in range(len(x)):
        plain = []
        for k, w in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                plain.append(max(0.0, max(sum(float(net.kernels[k][j, x[i, p + j], f]) for j in range(w)) for p in range(20 - w + 1)) + float(net.bias[k][f])))
        assert np.allclose(plain, h[i], atol=1e-5)
        z = [sum(plain[f] * float(net.out[f, c]) for f in range(len(plain))) + float(net.out_bias[c]) for c in range(3)]
        assert np.allclose(net.log_softmax(h)[i], [v - math.log(sum(map(math.exp, z))) for v in z], atol=1e-5)


def test_language_sample_is_bounded_and_reruns_agree(spark):
    rows = [(i % 7, f"text {i % 7} in some language", "xy"[i % 2]) for i in range(400)] + [(9, "the same text", "x")] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [langid.sample_windows(df.repartition(n), 5, 4, 1) for n in (2, 7)]
    assert got[0][2] == ["x", "y"] and np.array_equal(got[0][0], got[1][0]) and np.array_equal(got[0][1], got[1][1]) and max(np.bincount(got[0][1])) <= 5
    with pytest.raises(ValueError):
        langid.sample_windows(df, 5, 4, 1, max_labels=1)


def test_paired_kernels_equal_single_ones():
    net = langid.Network.fresh(["a", "b"], 1)
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(net.responses(x)[0], net.responses(x, net.paired())[0], atol=1e-4)


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ensemble = quality.fit(docs, labels.filter(~held_out()))
    scored = quality.score(docs.filter(held_out()), ensemble).join(labels, "doc_id")
    right, good = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert right > 0.95 and good > 0.97 and 0 < len(ensemble.rules) < 150
    out = quality.score(odd, ensemble)
    assert out.count() == len(ODD) and out.filter("score < 0 OR score > 1 OR predicted IS NULL").count() == 0 and "s" in out.columns
    assert quality.score(none, quality.fit(none, labels)).count() == 0


def test_tree_and_lasso_against_plain_ones():
    """The best first cut of a tree by trying all; the lasso's optimality conditions."""
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(200, 3)), rng.normal(size=200)
    g += (x[:, 1] > 0.4) * 2
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 20)[1:-1])) for j in range(3)]
    out = []
    quality._tree(x, g, np.arange(200), ["a", "b", "c"], cuts, 1, (), out, 3)
    cost = lambda j, c: sum(((g[m] - g[m].mean()) ** 2).sum() for m in (x[:, j] > c, x[:, j] <= c))
    best = min(((j, c) for j in range(3) for c in cuts[j] if 3 <= (x[:, j] > c).sum() <= 197), key=lambda jc: cost(*jc))
    assert out[0][0][0] == "abc"[best[0]] and out[0][0][2] == pytest.approx(best[1])
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(float)
    b0, b = quality._lasso(x, y, np.ones(200), 0.05, 4000)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ b + b0))) - y) / 200
    assert abs((1 / (1 + np.exp(-(x @ b + b0))) - y).mean()) < 1e-6
    assert all(abs(d + 0.05 * np.sign(w)) < 1e-5 if w else abs(d) <= 0.05 + 1e-6 for d, w in zip(gradient, b)) and (b == 0).any() and (b != 0).any()


def test_quality_sample_is_bounded_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i % 60, "word " * (i % 60)) for i in range(600)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3, "doc_id bigint, quality int")
    a, b = (quality.fit(docs.repartition(n), labels.repartition(n), sample=20, trees=3) for n in (2, 5))
    assert a == b


def test_rules_as_columns_equal_rules_as_arrays(spark, docs):
    rules = [quality.Rule((("upper", True, 0.01), ("word_length", False, 8.0)), 1.5), quality.Rule((("distinct_words", False, 0.6),), -2.0)]
    names = list(quality.statistics(F.lit("")))
    got = docs.select(F.struct(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).alias("s")).withColumn("score", quality.Ensemble(0.25, rules).column()).collect()
    x = np.asarray([[r["s"][k] for k in names] for r in got])
    z = 0.25 + sum(r.weight * r.holds(x, names) for r in rules)
    assert np.allclose([r["score"] for r in got], 1 / (1 + np.exp(-z)))


def test_odd_rows_everywhere(odd, none):
    n = len(ODD)
    for f in (jaccard.groups, spans.dedup, lambda d: katz.score(d.withColumn("held_out", F.lit(False))), packing.pack, lambda d: media.read_back(media.store(d))):
        assert f(none).count() == 0
        assert f(odd).count() >= n
    assert jaccard.groups(odd).filter("doc_id = 5").first()["component_id"] == 1
    again = {r["doc_id"]: r for r in spans.dedup(odd).collect()}
    assert not again[5]["text"].strip() and again[6]["text"] == LONG and again[2]["text"] is None


def test_words():
    codes, bounds, words = words_of(pa.array([" A b\tÉ\x0bb ", None, "", "x"]))
    assert [words[c].as_py() for c in codes.tolist()] == ["a", "b", "É", "b", "x"] and bounds.tolist() == [0, 4, 4, 4, 5]
