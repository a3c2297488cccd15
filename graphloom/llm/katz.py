"""Katz backoff scores of whole texts, with Good-Turing counts and exactly normalised backoff weights.

A bigram model over words as tables of packed arrays, one row for what one task tells another:

1. Each chunk of documents counts its bigrams and sends them, once each, to the part of their first word; the documents
   keep, packed, which of the chunk's bigrams they have how often.
2. A part holds all bigrams of its words: counts, the counts of the words themselves, and counts of counts, which sum to
   the model's discounts. It asks the parts of the second words for their counts.
3. With those, a part knows the backoff weight of each first word, and answers each chunk: the bigrams' counts and their
   second words', and once for each first word the sum of its counts and its weight, in double precision.
4. A chunk's documents take the answers: a seen bigram's discounted share, else the weight times the unigram, and add up.

Bigrams of a hot first word (the start of texts, and words that a sample shows to be common) go to the parts of their
second words instead, so that no part holds all of them. A second word's count is there, so each part sends counts of
counts of its share, and their sums, a bounded table, give the weights of hot words exactly.

So no token is a row anywhere, a word pair that is in every document is one entry a chunk, and the weight of a word that
is not hot is computed where all its followers are. Answers are looked up recursively: bigram, else weight times unigram.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, gathered, hashes, held_out, lean, relieve, remove, scratch, table, words_of

_KINDS = {"model": 0, "words": 1, "ask": 2, "stats": 3, "docs": 4, "told": 5, "answer": 6}
_MESSAGE = "dst bigint, kind int, src bigint, payload binary"
#: Stand-ins for the start and the end of a text; hot words have the names from HOT on, in order.
START, END, HOT = np.uint64(1), np.uint64(2), 3
#: Counts above this are taken as they are (Katz's k).
TRUSTED = 5
#: A hot word's sums, by slot: all its counts; pairs by count, then counts above TRUSTED summed; the same of the unigram
#: counts of words seen after it. Slots from SEEN on: hot words (by name) and the end seen after it.
ALL, PAIRS, LOWS, SEEN = 0, 1, 2 + TRUSTED, 3 + 2 * TRUSTED


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, byte planes apart so that small numbers compress."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
        out.append(struct.pack("<3sQI", a.dtype.str[-3:].encode().ljust(3), len(a), len(body)) + body)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<3sQI", data, at)
        at += struct.calcsize("<3sQI")
        kind = np.dtype(kind.decode().strip())
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, n * kind.itemsize)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(-1) if n else np.zeros(0, kind))
        at += size
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _messages(rows: list[tuple]) -> pa.Table:
    dst, kind, src, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"dst": pa.array(dst, pa.int64()), "kind": pa.array(kind, pa.int32()), "src": pa.array(src, pa.int64()), "payload": pa.array(payload, pa.binary())})


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _chunks(parts: int, hot: np.ndarray):
    """Step 1 for a chunk: its bigrams to the parts, its documents to a row of their own. hot: hashes in order of name."""
    limit = np.uint64(HOT + len(hot))

    def told(chunk: int, batch: pa.RecordBatch) -> pa.Table:
        codes, bounds, words = words_of(batch.column(2))
        codes = codes.astype(np.int32)
        names = np.concatenate([hashes(words), [START, END]]).astype(np.uint64)
        del words
        relieve()  # what splitting took
        if len(hot):
            at = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            names = np.where(hot[at] == names, at.astype(np.uint64) + np.uint64(HOT), names)
        n = np.diff(bounds)
        tokens = n + 1
        stops = np.cumsum(tokens)
        place = np.ones(int(stops[-1]), bool)
        place[stops - 1] = False
        following = np.full(len(place), len(names) - 1, np.int32)
        following[place] = codes
        del codes, place
        pair = np.empty(len(following), np.int64)
        pair[1:] = following[:-1]
        pair[stops - tokens] = len(names) - 2
        pair *= len(names)
        pair += following
        del following
        doc = np.repeat(np.arange(len(n), dtype=np.int32), tokens)
        train = ~np.asarray(batch.column(1).to_pylist(), bool)
        order = np.argsort(pair)
        pair = pair[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        kinds = pair[fresh]
        del pair
        inverse = np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del order, fresh
        counts = np.bincount(inverse[train[doc]], minlength=len(kinds)).astype(np.uint32)
        first, second = names[kinds // len(names)], names[kinds % len(names)]
        del kinds, names
        to = _part(np.where(first < limit, second, first), parts)
        order = np.lexsort((first, to))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        first, second, counts, to = first[order], second[order], counts[order], to[order]
        del order
        rows = []
        cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(to)]):
            at = np.flatnonzero(np.diff(first[a:b], prepend=first[a] + np.uint64(1)) != 0)
            rows.append((int(to[a]), _KINDS["model"], chunk, _pack(first[a:b][at], np.diff(np.append(at, b - a)).astype(np.uint32), second[a:b], counts[a:b])))
        del first, second, counts
        sums = doc.astype(np.int64) << 32
        del doc
        sums |= rank[inverse]
        del inverse, rank
        sums.sort()
        own = (sums & 0xFFFFFFFF).astype(np.int32)
        del sums
        steps = np.diff(own, prepend=np.int32(0))
        steps[stops - tokens] = own[stops - tokens]
        ids = np.asarray([i is not None for i in batch.column(0).to_pylist()], np.uint8)
        docs = np.asarray([i or 0 for i in batch.column(0).to_pylist()], np.int64)
        lengths = np.diff(np.append(cuts, len(to))).astype(np.uint32)
        rows.append((int(chunk % parts), _KINDS["docs"], chunk, _pack(docs, ids, (~train).astype(np.uint8), tokens.astype(np.uint32), steps.astype(np.uint32), to[cuts].astype(np.uint32), lengths)))
        return _messages(rows)

    def run(batches):
        for number, batch in enumerate(gathered(batches, "text", 8 << 20)):
            yield from told(TaskContext.get().partitionId() << 24 | number, batch).to_batches()
            del batch
            relieve()  # each chunk begins without what the last one took

    return run


def _tally(counts: np.ndarray) -> list[int]:
    """How many are 1 to TRUSTED, and the sum of those above."""
    return [*np.bincount(counts[counts <= TRUSTED], minlength=TRUSTED + 1)[1:].tolist(), int(counts[counts > TRUSTED].sum())]


def _hot_sums(name: int, followers: np.ndarray, counts: np.ndarray, words: np.ndarray, word_count: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(name, slot, number) of this part's share of a hot word: its followers here and how often each comes."""
    seen = followers[counts > 0]
    own = seen[seen >= limit]
    low = word_count[np.searchsorted(words, own)] if len(own) else np.zeros(0, np.int64)
    sums = [int(counts.sum()), *_tally(counts), *_tally(low)]
    return [(name, slot, n) for slot, n in enumerate(sums) if n] + [(name, SEEN + int(w), 1) for w in seen[seen < limit]]


def _gather(parts: int, limit: int):
    """Step 2 for a part: its bigrams as one table, its words, its share of the statistics, and what it asks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        relieve()
        here, out = key[0].as_py(), []
        first, second, count, chunk = [], [], [], []
        for kind, src, payload in zip(*(rows[c].to_pylist() for c in ("kind", "src", "payload"))):
            if kind == _KINDS["docs"]:
                out.append((src, kind, src, payload))
                continue
            words, n, followers, counts = _unpack(payload)
            first.append(np.repeat(words, n))
            second.append(followers)
            count.append(counts)
            chunk.append((src, len(followers)))
        if not first:
            return _messages(out)
        first, second, count = np.concatenate(first), np.concatenate(second), np.concatenate(count).astype(np.int64)
        order = np.lexsort((second, first))
        first, second, count = first[order], second[order], count[order]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(fresh)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(fresh) - 1
        total = np.add.reduceat(count, at)
        first, second = first[at], second[at]
        starts = np.flatnonzero(np.diff(first, prepend=first[0] + np.uint64(1)) != 0)
        sizes = np.diff(np.append(starts, len(first)))
        hot = first[starts] < np.uint64(limit)
        names = np.where(hot, first[starts], 0).astype(np.uint32)
        words, single = first[starts][~hot], np.add.reduceat(total, starts)[~hot]
        r = np.arange(1, TRUSTED + 2)
        stats = [*[(total == i).sum() for i in r], *[(single == i).sum() for i in r], single.sum(), (single > 0).sum()]
        sums = [(0, slot, int(n)) for slot, n in enumerate(stats)]
        for a, n, name in zip(starts[hot].tolist(), sizes[hot].tolist(), names[hot].tolist()):
            sums += _hot_sums(name, second[a : a + n], total[a : a + n], words, single, limit)
        out.append((here, _KINDS["stats"], here, np.asarray(sums, "<i8").tobytes()))
        out.append((here, _KINDS["words"], here, _pack(words, single.astype(np.uint64))))
        asked, index = np.unique(second, return_inverse=True)
        to = _part(asked, parts)
        by = np.argsort(to, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        asked, to = asked[by], to[by]
        cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(to)]):
            out.append((int(to[a]), _KINDS["ask"], here, _pack(asked[a:b])))
        entries, last = [], 0
        for src, n in chunk:
            entries.append(np.diff(of[last : last + n], prepend=0).astype(np.uint32))
            last += n
        out.append((here, _KINDS["model"], here, _pack(sizes.astype(np.uint32), names, total.astype(np.uint64), place[index].astype(np.uint32), np.asarray([c for c, _ in chunk], np.int64), np.asarray([n for _, n in chunk], np.uint32), np.concatenate(entries))))
        return _messages(out)

    return run


def _tell(hot: np.ndarray):
    """Counts of the words that other parts ask for. hot: counts by name of hot words and the end."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words, counts, asked, out = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], []
        for kind, src, payload in zip(*(rows[c].to_pylist() for c in ("kind", "src", "payload"))):
            if kind == _KINDS["words"]:
                words, counts = _unpack(payload)
            else:
                asked.append((src, _unpack(payload)[0]))
        for src, names in asked:
            at = np.minimum(np.searchsorted(words, names), max(0, len(words) - 1))
            found = np.where(words[at] == names, counts[at], 0) if len(words) else np.zeros(len(names), np.uint64)
            out.append((src, _KINDS["told"], key[0].as_py(), _pack(np.where(names < len(hot), hot[np.minimum(names, len(hot) - 1).astype(np.int64)], found).astype(np.uint64))))
        return _messages(out)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r up to TRUSTED by Good-Turing (n[r - 1] events are seen r times), scaled so that counts above are kept.
    Where those are no discounts (small or odd samples), a constant is taken off each count instead."""
    n = np.asarray(n, float)
    r = np.arange(1, TRUSTED + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (TRUSTED + 1) * n[TRUSTED] / n[0]
        d = ((r + 1) * n[1 : TRUSTED + 1] / (r * n[:TRUSTED]) - a) / (1 - a)
    if not (np.isfinite(d) & (d > 0) & (d < 1)).all():
        d = (r - (n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] and n[1] else 0.5)) / r
    return np.concatenate([[1.0], d])


class Model:
    """What all parts share: discounts, unigrams over the V words of the training tokens and one unknown, and the totals
    of hot words. ``sums``: (name, slot, number); name 0 has counts of counts of pairs and of other words, and their sums."""

    def __init__(self, sums: list[tuple[int, int, int]], hot_words: int = 0):
        stats, hot = np.zeros(2 * TRUSTED + 4, np.int64), np.zeros((HOT + hot_words, SEEN + HOT + hot_words), np.int64)
        for name, slot, number in sums:
            (hot[name] if name else stats)[slot] += number
        self.counts = hot[:, ALL].copy()
        self.counts[END], self.counts[START] = self.counts[START], 0  # the end of a text is a word of its own
        n = stats[TRUSTED + 1 : 2 * TRUSTED + 2].astype(float)
        for count in self.counts[(self.counts > 0) & (self.counts <= TRUSTED + 1)]:
            n[count - 1] += 1
        self.pairs, single = discounts(stats[: TRUSTED + 1]), discounts(n)
        self.tokens, self.kinds = int(stats[2 * TRUSTED + 2] + self.counts.sum()), int(stats[2 * TRUSTED + 3] + (self.counts > 0).sum())
        self.single = single
        r = np.arange(1, TRUSTED + 1)
        lost = float((n[:TRUSTED] * r * (1 - single[1:])).sum())
        self.extra = 0.0 if lost > 0 else 0.5  # without small counts, half a token makes room for the unknown
        self.unknown = (lost + self.extra) / (self.tokens + self.extra) if self.tokens else 1.0
        mass = lambda tally, d: tally[:, :TRUSTED] @ (r * d[1:]) + tally[:, TRUSTED]
        self.total, self.own = hot[:, ALL].astype(float), mass(hot[:, PAIRS:LOWS], self.pairs)
        low = mass(hot[:, LOWS:SEEN], single) / (self.tokens + self.extra) if self.tokens else np.zeros(len(hot))
        self.rest = 1 - low - hot[:, SEEN:] @ np.where(self.counts > 0, self.unigram(self.counts), 0.0)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c > TRUSTED, 1.0, self.single[np.minimum(c, TRUSTED)])
        return np.where(c > 0, d * c / (self.tokens + self.extra), self.unknown) if self.tokens else np.ones(len(c))

    def groups(self, sizes: np.ndarray, names: np.ndarray, c: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each first word: what its pairs' counts are divided by, its backoff weight, and whether all words are seen
        after it. ``sizes`` of the pairs have the same first word; names of hot ones, else 0; c are counts, low the
        unigrams."""
        starts = np.cumsum(sizes) - sizes
        is_hot = names > 0
        total = np.where(is_hot, self.total[names], np.add.reduceat(c, starts))
        own = np.where(is_hot, self.own[names], np.add.reduceat(self.kept(c), starts))
        rest = np.where(is_hot, self.rest[names], 1 - np.add.reduceat(np.where(c > 0, low, 0.0), starts))
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(own < total, 0.0, 0.5)  # a word with large counts only: half a count makes room
            weight = np.where(total > 0, (1 - own / (total + room)) / rest, 1.0)
        whole = rest <= 1e-12  # nothing to back off to
        return np.where(whole, total, total + room), np.where(whole, 1.0, weight), whole

    def kept(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > TRUSTED, 1.0, self.pairs[np.minimum(c, TRUSTED)]) * c

    def log(self, lengths: np.ndarray, by: np.ndarray, weight: np.ndarray, whole: np.ndarray, c: np.ndarray, single: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of pairs, ``lengths`` of which have the same first word (``groups``): the discounted
        count's share where they are seen, else the weight times the second word's unigram."""
        by, weight, whole = (np.repeat(x, lengths) for x in (by, weight, whole))
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(whole, c, self.kept(c)) / by
        return np.log10(np.where(c > 0, seen, weight * self.unigram(single)))


def _answer(model: Model):
    """Step 3 for a part: log10 probabilities, and counts of second words, bigram by bigram for each chunk."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        relieve()
        told, own, out = [], None, []
        for kind, src, payload in zip(*(rows[c].to_pylist() for c in ("kind", "src", "payload"))):
            if kind == _KINDS["told"]:
                told.append((src, payload))
            else:
                own = payload
        if own is None:
            return _messages(out)
        counts = np.concatenate([_unpack(p)[0] for _, p in sorted(told)]).astype(np.int64)
        sizes, names, c, index, chunks, lengths, steps = _unpack(own)
        c = c.astype(np.int64)
        sizes = sizes.astype(np.int64)
        by, weight, whole = model.groups(sizes, names.astype(np.int64), c, model.unigram(counts)[index])
        of, single, last = np.repeat(np.arange(len(sizes)), sizes), counts[index], 0
        for chunk, n in zip(chunks.tolist(), lengths.tolist()):
            at = np.cumsum(steps[last : last + n].astype(np.uint32), dtype=np.uint32)
            first = np.flatnonzero(np.diff(of[at], prepend=-1))  # of the pairs of one first word, which stand together
            group, length = of[at][first], np.diff(np.append(first, n))
            twice = (2 * by[group]).astype(np.int64)
            out.append((chunk, _KINDS["answer"], key[0].as_py(), _pack(_narrow(length), _narrow(twice), weight[group], whole[group].astype(np.uint8), _narrow(c[at]), _narrow(single[at]))))
            last += n
        return _messages(out)

    return run


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _add(model: Model):
    """Step 4 for a chunk: each document's sums."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        relieve()
        answers, own = {}, None
        for kind, src, payload in zip(*(rows[c].to_pylist() for c in ("kind", "src", "payload"))):
            if kind == _KINDS["answer"]:
                answers[src] = payload
            else:
                own = payload
        docs, known, held, tokens, steps, parts, lengths = _unpack(own)
        found = [_unpack(answers[p]) for p in parts.tolist()]
        if [len(f[4]) for f in found] != lengths.tolist():
            raise ValueError("answers do not fit the chunk")
        count = np.concatenate([f[5] for f in found]).astype(np.int64)
        log = np.concatenate([model.log(length.astype(np.int64), twice / 2, weight, whole.astype(bool), c.astype(np.int64), single.astype(np.int64)) for length, twice, weight, whole, c, single in found])
        starts = np.cumsum(tokens.astype(np.int64)) - tokens
        sums = np.cumsum(steps.astype(np.int64))
        at = sums - np.repeat(np.concatenate([[0], sums])[starts], tokens)
        base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.kinds + 1)))
        n = len(docs)
        return pa.table({
            "doc_id": pa.array(docs, mask=known == 0), "held_out": held.astype(bool), "n_tokens": tokens.astype(np.int64),
            "n_known": np.add.reduceat((count > 0)[at].astype(np.int64), starts), "train_tokens": np.full(n, model.tokens, np.int64),
            "base_score": np.add.reduceat(base[at], starts), "score": np.add.reduceat(log[at], starts),
        })

    return run


def hot_hashes(docs: DataFrame, size: int, most: int = 256, sample_bytes: int = 64 << 20) -> np.ndarray:
    """Sorted hashes of the ``most`` commonest words (of up to 64 characters) in a sample of about ``sample_bytes`` of the
    texts, taken by hash of id and text. They say where counts meet, not what they are: any choice gives equal scores."""
    if not most:
        return np.zeros(0, np.uint64)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size // sample_bytes))) == 0)
    words = sample.select(F.explode(F.split(lower, "[ \\t-\\r]+")).alias("word")).filter("length(word) BETWEEN 1 AND 64")
    common = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()
    return np.unique(hashes(pa.array([r["word"] for r in common], pa.string())))


def score(docs: DataFrame, part_bytes: int = 24 << 20, hot_words: int = 256) -> DataFrame:
    """Scores of all whole texts of ``docs`` (doc_id, text, held_out), by a model of those not held out.

    Tokens are the words (A-Z in lower case, cut at ASCII white space) and one end. n_known: tokens with a count in the
    training texts; train_tokens: all of those; base_score: the sum of log10 of unigrams with half a count more for each
    word and one unknown; score: the sum of log10 of the Katz model, in which a word that training lacks is the one
    unknown. Null text is empty (the end alone); repeated rows count as often as they come; without training texts all
    probabilities are 1; an empty table gives an empty result; other columns are ignored. Words go by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    hot = hot_hashes(docs, size, hot_words)
    said = docs.mapInArrow(lean(_chunks(parts, hot)), _MESSAGE).groupBy("dst").applyInArrow(_gather(parts, HOT + len(hot)), _MESSAGE)
    folder, written = scratch(spark, "katz"), spark.read.schema(_MESSAGE)
    said.write.partitionBy("kind").parquet(f"{folder}/parts")
    said = written.parquet(f"{folder}/parts").select("dst", "kind", "src", "payload")
    forget(spark)
    kind = lambda *names: F.col("kind").isin([_KINDS[n] for n in names])
    sums = said.filter(kind("stats")).mapInArrow(_numbers, "name bigint, slot bigint, number bigint").groupBy("name", "slot").agg(F.sum("number"))
    model = Model([tuple(r) for r in sums.collect()], len(hot))  # a bounded table: a row for each hot word and slot
    told = said.filter(kind("words", "ask")).groupBy("dst").applyInArrow(_tell(model.counts.astype(np.uint64)), _MESSAGE)
    told.write.parquet(f"{folder}/told")
    remove(spark, *(f"{folder}/parts/kind={_KINDS[k]}" for k in ("stats", "words", "ask")))
    told = written.parquet(f"{folder}/told")
    answers = said.filter(kind("model")).unionByName(told).groupBy("dst").applyInArrow(_answer(model), _MESSAGE)
    answers.write.parquet(f"{folder}/answers")
    remove(spark, f"{folder}/told", f"{folder}/parts/kind={_KINDS['model']}")
    answers = written.parquet(f"{folder}/answers")
    forget(spark)
    return said.filter(kind("docs")).unionByName(answers).groupBy("dst").applyInArrow(_add(model), _SCORED)


def _numbers(batches):
    """The statistics of each part as rows (name, slot, number)."""
    for batch in batches:
        for data in batch.column(3).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(data, "<i8").reshape(-1, 3).T.copy()], ["name", "slot", "number"])


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", held_out(remainder=1).alias("held_out")))
