"""Substring dedup over sliding spans of sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import forget, hashes, lean, mixed, pieces, settle, table, words_of

#: Text is cut behind each run of sentence ends and line breaks; the pieces put together are the text.
SENTENCE = re.compile(rb"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
#: The same with the full stops of Chinese and Japanese; texts without them are cut alike by both.
_WIDE_STOP = re.compile("\u3002|\uff01|\uff0e|\uff1f|\uff61".encode())
_ANY_STOP = rb"(?:[.!?\n]|" + _WIDE_STOP.pattern + rb")"
WIDE_SENTENCE = re.compile(rb"(?:(?!%b).)*%b+|(?:(?!%b).)+" % ((_ANY_STOP,) * 3), re.DOTALL)
_SAYS = re.compile(rb"[^ \t-\r.!?]")
#: Sentences of a span.
SPAN = 3
#: Words of a run that the pipeline takes for a repeated passage.
WORDS = 50


def sentences(text: bytes) -> tuple[list[bytes], list[int]]:
    """All pieces, and which of them say something (the sentences)."""
    found = (WIDE_SENTENCE if _WIDE_STOP.search(text) else SENTENCE).findall(text)
    return found, [i for i, s in enumerate(found) if _SAYS.search(s)]


_PLACE = np.dtype([("did", "<i8"), ("th", "<i8"), ("pos", "<i4")])
_WORD = re.compile(rb"[^ \t-\r]+")


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each place, of runs of powers of two that are put together."""
    out, done, level, size = None, 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out = level if out is None else mixed(out[: len(level) - done] * np.uint64(0x9E3779B97F4A7C15) + level[done:])
                done += size
            if done == n or len(words) < n:
                return out if done == n else np.zeros(0, np.uint64)
            level, size = mixed(level[: len(level) - size] * np.uint64(0xC2B2AE3D27D4EB4F) + level[size:]), 2 * size


def _extreme(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of the n numbers from each place."""
    size = 1
    while 2 * size <= n:
        x, size = f(x[: len(x) - size], x[size:]), 2 * size
    return f(x[: len(x) - n + size], x[n - size :]) if n > size else x


def _word_runs(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """For each place of a run of n words that lies in one text: the place among all words, its least hash of a shorter run
    (half of n or more), those hashes, where each text's words begin, and the words' codes and the words."""
    codes, bounds, words = words_of(part.column(2))
    half = n - n // 2
    short = _runs(hashes(words)[codes], half) | np.uint64(1)
    inside = np.ones(max(0, len(codes) - n + 1), bool)
    for end in bounds[1:-1].tolist():
        inside[max(0, end - n + 1) : end] = False
    at = np.flatnonzero(inside)
    least = _extreme(np.minimum, short, n - half + 1)[at] if len(at) else np.zeros(0, np.uint64)
    return at, least, short, bounds, (codes, words)


def _spans_of(n: int):
    """Runs of n sentences: their 128-bit hashes, and text and place of each."""

    def found_in(part: pa.RecordBatch):
        sizes, digest = [], []
        for text in part.column(2).cast(pa.binary()).to_pylist():
            found, says = sentences(text or b"")
            hashed = [xxhash.xxh3_128_digest(b" ".join(found[i].lower().split())) for i in says]
            own = [xxhash.xxh3_128_digest(b"".join(hashed[i : i + n])) for i in range(len(hashed) - n + 1)]
            sizes.append(len(own))
            digest += own
        h, ends = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2), np.cumsum(sizes)
        return h, np.repeat(np.arange(len(sizes)), sizes), np.arange(len(h)) - np.repeat(ends - sizes, sizes)

    return found_in


def _marks_of(n: int):
    """The shorter runs whose hash is the least in some run of n words: equal runs of n words have an equal one."""

    def found_in(part: pa.RecordBatch):
        at, least, short, bounds, _ = _word_runs(part, n)
        reach = n // 2
        best = np.zeros(len(short) + reach, np.uint64)  # of the run that begins so many places later
        best[at + reach] = least
        marks = np.flatnonzero(_extreme(np.maximum, best, reach + 1) == short) if len(at) else at
        doc = np.searchsorted(bounds, marks, "right") - 1
        return np.stack([short[marks].view(np.int64), np.zeros(len(marks), np.int64)], 1), doc, marks - bounds[doc]

    return found_in


def _passages_of(n: int):
    """Runs of n words whose mark is at one of the places in the fourth column: 128-bit hashes, and text and place of each."""

    def found_in(part: pa.RecordBatch):
        at, least, short, bounds, (codes, words) = _word_runs(part, n)
        ranges, many = part.column(3).flatten().to_numpy(), part.column(3).value_lengths().to_numpy()
        sizes = (ranges & 0xFFFFFFFF) - (ranges >> 32)
        places = np.repeat(np.repeat(bounds[:-1], many) + (ranges >> 32) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        keep = np.isin(least, short[places])
        at = at[keep]
        h = np.stack([_runs(hashes(words, seed)[codes], n)[at].view(np.int64) for seed in (1, 2)], 1) if len(at) else np.zeros((0, 2), np.int64)
        doc = np.searchsorted(bounds, at, "right") - 1
        return h, doc, at - bounds[doc]

    return found_in


def _span_rows(docs: DataFrame, found_in, places: bool) -> DataFrame:
    """What ``found_in`` finds in each chunk of documents, one row for each different one there: h1, h2 (its hash) and how
    often it comes (n) and where first (did, th, pos); or, with ``places``, chunk, h1, h2 and all places."""

    def run(batches):
        number = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                h, doc, pos = found_in(part)
                rows = np.empty(len(h), _PLACE)
                rows["did"], rows["th"], rows["pos"] = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc], pos
                order = np.lexsort((rows["pos"], rows["th"], rows["did"], h[:, 1], h[:, 0]))
                h, rows = h[order], rows[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]).any(1)
                starts = np.flatnonzero(fresh)
                columns = {"h1": h[starts, 0], "h2": h[starts, 1]}
                if places:
                    cuts = np.append(starts, len(rows)).astype(np.int32) * np.int32(_PLACE.itemsize)
                    all_places = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(rows.tobytes())])
                    columns = {"chunk": np.full(len(starts), TaskContext.get().partitionId() << 32 | number)} | columns | {"places": all_places}
                else:
                    columns |= {"n": np.diff(np.append(starts, len(rows)))} | {c: np.ascontiguousarray(rows[c][starts]) for c in ("did", "th", "pos")}
                number += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    shape = "chunk bigint, h1 bigint, h2 bigint, places binary" if places else "h1 bigint, h2 bigint, n bigint, did bigint, th bigint, pos int"
    return docs.mapInArrow(lean(run), shape)


def _later(n: int, first_too: bool, first_whole: bool):
    """Of a chunk's repeated spans of n: what each document's places but the first of all (or all places) cover, as ranges
    (start << 32 | end) that do not overlap. With ``first_whole`` a repeat that overlaps the first begins at its end."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        packed = rows["places"].combine_chunks().to_pylist()
        places = np.frombuffer(b"".join(packed), _PLACE)
        times = np.fromiter((len(p) // _PLACE.itemsize for p in packed), np.int64, len(packed))
        first = [np.repeat(rows[c].to_numpy(), times) for c in ("did", "th", "pos")]
        same = (places["did"] == first[0]) & (places["th"] == first[1])
        start, end = places["pos"].astype(np.int64), places["pos"].astype(np.int64) + n
        if first_whole:
            start = np.where(same, np.maximum(start, first[2].astype(np.int64) + n), start)
        kept = np.flatnonzero(start < end) if first_too else np.flatnonzero((start < end) & ~(same & (places["pos"] == first[2])))
        did, th, start, end = places["did"][kept], places["th"][kept], start[kept], end[kept]
        order = np.lexsort((end, start, th, did))
        did, th, start, end = did[order], th[order], start[order], end[order]
        other = np.ones(len(did), bool)
        other[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1])
        # ends grow with the document's number, so that the greatest end so far is one of the same document
        base = np.cumsum(other) << 32
        reach = np.maximum.accumulate(base + end) if len(end) else end
        fresh = other.copy()
        fresh[1:] |= start[1:] + base[1:] > reach[:-1]
        at = np.flatnonzero(fresh)
        ends = (reach - base)[np.append(at[1:], len(did)) - 1] if len(at) else end
        offsets = np.append(np.flatnonzero(other[at]), len(at))
        hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(start[at] << 32 | ends, pa.int64()))
        return pa.table({"did": np.ascontiguousarray(did[other]), "th": np.ascontiguousarray(th[other]), "hits": hits})

    return run


def _repeats(docs: DataFrame, found_in, later, name: str) -> DataFrame:
    """did, th and the ranges (hits) that ``later`` makes of what ``found_in`` finds more than once in all of ``docs``."""
    place = F.struct("did", "th", "pos")
    repeated = _span_rows(docs, found_in, False).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.sum("n").alias("n")).filter("n > 1").select("h1", "h2", "first.*")
    repeated = settle(repeated, f"{name}-repeated")
    forget(docs.sparkSession)
    back = _span_rows(docs, found_in, True).join(repeated, ["h1", "h2"]).select("chunk", "places", "did", "th", "pos")
    ranges = back.groupBy("chunk").applyInArrow(later, "did bigint, th bigint, hits array<bigint>")
    hits = settle(ranges.groupBy("did", "th").agg(F.flatten(F.collect_set("hits")).alias("hits")), f"{name}-hits")  # equal rows have equal hits
    forget(docs.sparkSession)
    return hits


def _joined(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """``docs`` with their hits, by a merge at every size: hits in memory are several times their file, by which Spark would
    choose to broadcast them, and a plan that changes as they grow takes disk out of proportion."""
    return docs.join(hits.withColumnsRenamed({"did": "hit_did", "th": "hit_th"}).hint("merge"), (F.col("did") == F.col("hit_did")) & (F.col("th") == F.col("hit_th")), how).drop("hit_did", "hit_th")


def _cut(text: bytes, hits: list[int], runs: list[int]) -> tuple[bytes, int, int]:
    """The text without ranges of sentences (hits) and words (runs); its sentences, and those that lost something."""
    found, says = sentences(text)
    if not hits and not runs:
        return text, len(says), 0
    ends = np.cumsum([len(s) for s in found])
    gone = np.zeros(len(text) + 1, bool)
    for i in (i for r in hits for i in range(r >> 32, r & 0xFFFFFFFF)):
        gone[ends[says[i]] - len(found[says[i]]) : ends[says[i]]] = True
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)] if runs else []
    for r in runs:
        gone[starts[r >> 32] : starts[r & 0xFFFFFFFF]] = True
    lost = sum(bool(gone[ends[i] - len(found[i]) : ends[i]].any()) for i in says)
    return np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes(), len(says), lost


def dedup(docs: DataFrame, span: int = SPAN, words: int = 0) -> DataFrame:
    """Remove from each text (doc_id, text) the sentences in any repeat of a span but its first.

    A span is any ``span`` sentences in a row (two at least), whatever their words; a sentence ends behind full stops,
    exclamation and question marks (those of Chinese and Japanese too) and line breaks, and has something else. Spans
    are compared in lower case (A-Z) with white space made one space. The first of equal spans is the one of the smallest
    doc_id (null before all), then place; repeats may lie in other documents or further on in the same one. Adds
    n_sentences and n_removed, which replace columns of these names, and replaces text by what is left (and n_chars,
    where it is a column, by its length); all other columns stay. Null text stays null, without sentences; rows equal in
    doc_id and text count as one document, so all of them keep the same; an empty table gives an empty one.

    With ``words`` (two at least) any repeat of so many words in a row (between ASCII white space, A-Z in lower case) goes
    too, wherever sentences end, with the white space behind it: every passage of that length. Where a repeat overlaps the
    first of the same text, what overlaps stays. n_removed then counts sentences of which anything is gone.

    Spans meet by their hash alone, and a chunk of documents brings each different one once, however many of them have
    it: counts are summed before the shuffle, and only spans that do repeat go back to their chunk, with the first place.
    Of the runs of words only those meet that share a mark: the shorter run in them with the least hash, which equal runs
    have alike, so that no repeat is missed; marks, of which there are few, meet first.
    """
    if span < 2 or words and words < 2:
        raise ValueError("a span has two sentences at least, a run two words")
    taken = {c.lower() for c in docs.columns}
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"), "text")
    texts = keyed.select("did", "th", "text")
    hits, whole = _repeats(texts, _spans_of(span), _later(span, False, False), "spans"), keyed.select("row", "did", "th")
    none = F.lit(None).cast("array<bigint>")
    if words:
        marks = _repeats(texts, _marks_of(words), _later(1, True, False), "spans-marks").select("did", "th", none.alias("hits"), F.col("hits").alias("marks"))
        both = hits.select("did", "th", "hits", none.alias("marks")).unionByName(marks).groupBy("did", "th").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.first("marks", True).alias("marks"))
        found = settle(_joined(whole, both, "left"), "spans-marked")
        forget(docs.sparkSession)
        likely = found.filter("marks IS NOT NULL")  # only these meet the runs of words
        runs = _repeats(likely.select("did", "th", F.col("row")["text"].alias("text"), "marks"), _passages_of(words), _later(words, False, True), "spans-words")
        joined = _joined(likely.select("row", "did", "th", "hits"), runs.withColumnRenamed("hits", "runs"), "left").select("row", "hits", "runs")
        joined = joined.unionByName(found.filter("marks IS NULL").select("row", "hits", none.alias("runs")))
    else:
        joined = _joined(whole, hits, "left").select("row", "hits", none.alias("runs"))
    shape = StructType([joined.schema["row"], *StructType.fromDDL("kept string, n_sentences int, n_removed int")])

    def cut(batches):
        for batch in batches:
            texts = batch.column(0).field("text").cast(pa.binary()) if batch.num_rows else []
            kept, removed, counts = [], [], []
            for text, hit, run in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, count, lost = _cut(text.as_py() or b"", hit or [], run or [])
                kept.append(left if text.is_valid else None)
                removed.append(lost)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], ["row", "kept", "n_sentences", "n_removed"])

    out = joined.mapInArrow(lean(cut), shape)
    own = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast("long")} if "n_chars" in taken else {})
    columns = [own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    return out.select(*columns, "n_sentences", "n_removed")


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


_STOPS = ".!?\\n\u3002\uff01\uff0e\uff1f\uff61"
OP7_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS ord
  FROM (SELECT doc_id, regexp_extract_all(text, '[^{_STOPS}]*[{_STOPS}]+|[^{_STOPS}]+') AS p FROM documents)
), says AS (
  SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g')) AS said
  FROM pieces WHERE regexp_matches(piece, '[^ \t-\r.!?]')
), spans AS (
  SELECT a.doc_id, a.pos, row_number() OVER (PARTITION BY a.said, b.said, c.said ORDER BY a.doc_id, a.pos) AS nth
  FROM says a JOIN says b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN says c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
), gone AS (
  SELECT DISTINCT s.doc_id, s.ord FROM spans r JOIN says s ON s.doc_id = r.doc_id AND s.pos >= r.pos AND s.pos < r.pos + {SPAN} WHERE nth > 1
), kept AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.ord) AS text FROM pieces p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.ord = g.ord GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  CAST(coalesce(s.n, 0) AS INTEGER) AS n_sentences, CAST(coalesce(g.n, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM says GROUP BY 1) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""
