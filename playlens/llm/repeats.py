"""Repeated passages: every byte covered by a string of ``length`` bytes that starts anywhere else too.

Meeting. Each window of ``length`` bytes has an anchor: its least hashed substring of ANCHOR bytes, the leftmost of equals.
Equal windows have equal anchors at equal places. The windows of a text that share an anchor are one segment; segments
meet by their anchor's hash. Segments whose bytes are equal are repeated as a whole, and one of them stands for all.

Judging. Different segments that meet are laid side by side into one text, and its Burrows-Wheeler transform is
extended backwards breadth-first from the empty string: each round holds the suffix intervals of all strings of one length
that still tell two neighbours apart, so common prefixes of neighbouring suffixes come out by increasing value. It stops at
``length``: a suffix that no shorter string has parted from its neighbour starts a repeated window.

Hot anchors. A group of more than GROUP different segments isn't judged as it is. Its windows are cut into cells by their
distance from the anchor; only cells that share the bytes common to all of their windows meet again, equal cells are
repeated as a whole, and cells are cut again while a group is too large, down to single windows. Nothing is dropped.

Null and short texts have nothing to remove. Rows that repeat an id and a text are repeats of each other. Texts of any
length are handled in overlapping stretches of 8 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import parts, store, text_of

LENGTH = 400
ANCHOR = 128
GROUP = 1500
BATCH_BYTES = 400_000
STRETCH = 8_000_000
CELLS = (64, 16, 4, 1)
NO_ID = -(1 << 63)
_POS = np.uint64((1 << 24) - 1)
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(16)], np.uint64)


def _substring_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every substring of ``size`` bytes (a power of two), by doubling."""
    h, width, turn = _TABLE[raw], 1, 0
    while width < size:
        h = h[:-width] * _ODD[turn] + h[width:]
        h ^= h >> np.uint64(29)
        width, turn = 2 * width, turn + 1
    return h * _ODD[turn]


def segments_of(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor place, anchor hash) of the segments of a text."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(len(raw) - length + 1, 0), STRETCH):
        own = np.frombuffer(raw, np.uint8, min(STRETCH + length - 1, len(raw) - at), at)
        h = _substring_hashes(own, anchor)
        least = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        window, width = length - anchor + 1, 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(own) - length + 1], least[window - width :])
        place = (least & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        for got, new in zip(out, (first + at, last + at, place[first] + at, h[place[first]].view(np.int64)), strict=True):
            got.append(new)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


_SEGMENT = "doc_id long, mark long, ref long, meeting long, span long"


def _marks(text: Column) -> tuple[Column, Column]:
    """96 bits of two hashes of the text: with the id, they name a row. Rows alike in all of them have the same text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0xFFFFFFFF))


def _mark(mark: str, low: str | Column) -> Column:
    """Both marks as one string."""
    return F.concat_ws("-", F.col(mark), low)


def _segments(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = xxhash.xxh3_64_intdigest
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                some, cols = pdf.iloc[i : i + 1000], [[], [], [], [], []]
                for doc, text, mark, low in zip(some["doc_id"], some["text"], some["mark"], some["low"], strict=True):
                    raw = text.encode("utf-8", "replace")
                    if len(raw) < length:
                        continue
                    first, last, _, meeting = segments_of(raw, length)
                    span = [hashed(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    own = np.full(len(first), NO_ID if pd.isna(doc) else int(doc)), np.full(len(first), mark), (np.int64(low) << 32) | np.arange(len(first)), meeting, np.array(span, np.uint64).view(np.int64)
                    for col, new in zip(cols, own, strict=True):
                        col.append(new)
                if cols[0]:
                    yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(("doc_id", "mark", "ref", "meeting", "span"), cols, strict=True)})

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more, by prefix doubling; ties in any order."""
    n = len(text)
    rank, width = np.zeros(n, np.int64), 7
    for i in range(width):  # seven symbols of nine bits fit at once
        rank <<= 9
        rank[: max(n - i, 0)] |= text[i:]
    order = np.argsort(rank)
    key = rank[order]
    rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    while width < depth and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        if width < n:
            after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        width *= 2
    return order


def repeated_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``text`` whether the ``length`` symbols from there start anywhere else too.

    ``parted[i]`` says that suffixes i-1 and i (in order) differ within ``length``. Round r extends the intervals of strings of
    r symbols by each symbol before them; an interval that parts its end from its successor for the first time is kept.
    """
    text = np.append(text + 1, 0)  # an end that is before every symbol and stands once
    n = len(text)
    order = suffix_order(text, length + 1)
    before = text[order - 1]  # the transform
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)  # from a suffix to the one that starts a symbol earlier
    head = text[order]
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    owner = np.full(n, -1, np.int64)
    start, stop = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = stop - start
        total = int(size.sum())
        if not total:
            break
        mine = np.repeat(np.arange(len(start)), size)
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        to = back[inside]
        if total > n // 8:  # sort by marking places
            owner[to] = mine
            to = np.flatnonzero(owner >= 0)
            mine = owner[to]
            owner[to] = -1
        else:
            sort = np.argsort(to)
            to, mine = to[sort], mine[sort]
        new = np.concatenate(([True], (to[1:] != to[:-1] + 1) | (mine[1:] != mine[:-1]) | (head[to[1:]] != head[to[:-1]])))
        at = np.flatnonzero(new)
        start, stop = to[at], to[np.append(at[1:], total) - 1] + 1
        fresh = ~parted[stop]
        start, stop = start[fresh], stop[fresh]
        parted[stop] = True
    same = np.zeros(n, bool)
    same[order[~parted[:n]]] = True
    same[order[:-1][~parted[1:n]]] = True
    return same[:-1]


def _judge(segments: list[bytes], length: int) -> list[np.ndarray]:
    """Per segment, whether each of its windows is repeated among all of them."""
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0) for s in segments])
    same = repeated_suffixes(text, length)
    starts = np.cumsum([0] + [len(s) + 1 for s in segments])
    return [same[a : a + len(s) - length + 1] for a, s in zip(starts.tolist(), segments, strict=False)]


_PENDING = "doc_id long, mark string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, raw binary, covered array<struct<start:int,stop:int>>, judged array<struct<meeting:bigint,solo:boolean,large:boolean,first:int,last:int,place:int>>"


def _digest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(bytes, removed, removed runs, SHA-256 of the rest) of a text whose covered stretches are ``spans``."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    rest, at = hashlib.sha256(), 0
    for a, b in runs:
        rest.update(raw[at:a])
        at = b
    rest.update(raw[at:])
    return len(raw), sum(b - a for a, b in runs), len(runs), rest.hexdigest()


def _open(length: int):
    """Documents with their met segments: finished where nothing is left to judge, else with their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                rows = []
                some = pdf.iloc[i : i + 500]
                for doc, mark, text, met in zip(some["doc_id"], some["mark"], some["text"], some["met"], strict=True):
                    raw, covered, judged = text.encode("utf-8", "replace"), [], []
                    if met is not None and len(met):
                        first, last, place, meeting = (x.tolist() for x in segments_of(raw, length))
                        for m in met:
                            k = m["index"]
                            if m["judged"]:
                                judged.append({"meeting": meeting[k], "solo": m["solo"], "large": m["large"], "first": first[k], "last": last[k], "place": place[k]})
                            if not m["solo"]:
                                covered.append((first[k], last[k] + length))
                    done = _digest(raw, covered) if not judged else (len(raw), None, None, None)
                    own = [{"start": a, "stop": b} for a, b in covered] if judged else None
                    rows.append((None if pd.isna(doc) else int(doc), mark, *done, raw if judged else None, own, judged or None))
                got = pd.DataFrame(rows, columns=["doc_id", "mark", "n_bytes", "n_removed", "n_spans", "kept_sha256", "raw", "covered", "judged"])
                yield got.astype({"doc_id": "Int64", "n_removed": "Int64", "n_spans": "Int64"})

    return run


_CELL = "meeting long, doc_id long, mark string, first int, last int, place int, raw binary, solo boolean"
_SPAN = "doc_id long, mark string, start int, stop int"


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _judged(length: int):
    def judge(rows: list[tuple]) -> pd.DataFrame:
        out = []
        for (doc, mark, first, solo, _), flags in zip(rows, _judge([r[4] for r in rows], length), strict=True):
            if solo:
                out += [(doc, mark, first + a, first + b + length) for a, b in _intervals(flags)]
        return pd.DataFrame(out, columns=["doc_id", "mark", "start", "stop"]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by meeting; whole groups are judged together until a batch is full."""
        held: list[tuple] = []
        size, last = 0, None
        for pdf in batches:
            for meeting, doc, mark, first, solo, raw in zip(*(pdf[c] for c in ("meeting", "doc_id", "mark", "first", "solo", "raw")), strict=True):
                if size >= BATCH_BYTES and meeting != last:
                    yield judge(held)
                    held, size = [], 0
                held.append((None if pd.isna(doc) else int(doc), mark, first, solo, raw))
                size, last = size + len(raw), meeting
        if held:
            yield judge(held)

    return run


def _cut(length: int, width: int):
    """Cells of ``width`` windows, by their distance from the anchor: core is what all windows of a cell hold, whole its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = lambda *x: int(np.array(xxhash.xxh3_64_intdigest(b"|".join(x)), np.uint64).view(np.int64))
        for pdf in batches:
            rows = []
            for meeting, doc, mark, first, last, place, raw, solo in zip(*(pdf[c] for c in ("meeting", "doc_id", "mark", "first", "last", "place", "raw", "solo")), strict=True):
                at = first
                while at <= last:  # windows whose distances from the anchor fall into one cell
                    cell = (place - at) // width
                    end = min(last, place - cell * width)
                    own, lo = raw[at - first : end - first + length], place - cell * width
                    core = raw[lo - first : lo - width + 1 + length - first]
                    rows.append((hashed(str(meeting).encode(), str(cell).encode(), core), doc, mark, at, end, place, own, solo, hashed(own)))
                    at = end + 1
            yield pd.DataFrame(rows, columns=["meeting", "doc_id", "mark", "first", "last", "place", "raw", "solo", "whole"]).astype({"doc_id": "Int64"})

    return run


def _refine(rows: DataFrame, length: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(cells to judge, covered spans) of groups that are too large: cut, let meet again, and again where still too large."""
    small, covered = [], []
    for width in CELLS:
        if rows.isEmpty():
            break
        cells = store(rows.mapInPandas(_cut(length, width), _CELL + ", whole long"), f"cells-{width}")
        equal = cells.groupBy("meeting", "whole").agg(F.count("*").alias("copies"))
        met = equal.groupBy("meeting").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
        kept = store(cells.join(equal, ["meeting", "whole"]).join(met, "meeting"), f"met-{width}")
        covered.append(kept.filter("copies > 1 AND solo").select("doc_id", "mark", F.col("first").alias("start"), (F.col("last") + length).alias("stop")))
        reps = kept.filter("kinds > 1").dropDuplicates(["meeting", "whole"]).withColumn("solo", F.expr("solo AND copies = 1"))
        fields = [f.split()[0] for f in _CELL.split(", ")]
        small.append(reps.filter(F.col("kinds") <= group).select(*fields))
        rows = reps.filter(F.col("kinds") > group).select(*fields)
    return small, covered


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256 (of the bytes that stay)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    mark, low = _marks(F.col("text"))
    rows = rows.withColumn("mark", mark).withColumn("low", low)
    n = parts(docs.sparkSession)
    segments = store(rows.mapInPandas(_segments(length), _SEGMENT), "segments")
    met = segments.groupBy("meeting").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).filter("n > 1")
    # Stored first: a join of two plain tables can be split where one meeting has very many rows.
    met = store(met.select("meeting", (F.col("low") != F.col("high")).alias("mixed")), "meetings")
    hits = store(segments.join(met, "meeting"), "segments-met")
    kinds = store(hits.filter("mixed").groupBy("meeting", "span").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "ref")).alias("one")), "segment-kinds")
    groups = kinds.groupBy("meeting").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("least = 1")
    judged = kinds.join(groups, "meeting").select("one.doc_id", "one.mark", "one.ref", F.lit(True).alias("judged"), (F.col("copies") == 1).alias("solo"), (F.col("kinds") > group).alias("large"))
    same = hits.filter("NOT mixed").select("doc_id", "mark", "ref").unionByName(hits.filter("mixed").join(kinds.filter("copies > 1").select("meeting", "span"), ["meeting", "span"]).select("doc_id", "mark", "ref"))
    same = same.select("doc_id", "mark", "ref", F.lit(False).alias("judged"), F.lit(False).alias("solo"), F.lit(False).alias("large"))
    every = judged.unionByName(same).select("doc_id", _mark("mark", F.shiftrightunsigned("ref", 32)).alias("mark"), F.struct(F.col("ref").bitwiseAND(F.lit(0xFFFFFFFF)).alias("index"), "judged", "solo", "large").alias("met"))
    of_doc = every.groupBy("doc_id", "mark").agg(F.collect_list("met").alias("met")).withColumnRenamed("doc_id", "key").withColumnRenamed("mark", "key_mark")
    rows = rows.withColumn("mark", _mark("mark", "low"))
    keyed = rows.join(of_doc, (F.coalesce(rows["doc_id"], F.lit(NO_ID)) == of_doc["key"]) & (rows["mark"] == of_doc["key_mark"]), "left")
    state = store(keyed.select("doc_id", "mark", "text", "met").mapInPandas(_open(length), _PENDING), "repeats-open")
    pending = state.filter("raw IS NOT NULL")
    flat = pending.select("doc_id", "mark", "raw", F.inline("judged"))
    fields = ("meeting", "doc_id", "mark", "first", "last", "place", F.substring("raw", F.col("first") + 1, F.col("last") - F.col("first") + length).alias("raw"), "solo")
    small, covered = _refine(flat.filter("large").select(*fields), length, group)
    cells = reduce(DataFrame.unionByName, small, flat.filter("NOT large").select(*fields))
    dealt = cells.select("meeting", "doc_id", "mark", "first", "raw", "solo").repartition(n, "meeting").sortWithinPartitions("meeting")
    found = reduce(DataFrame.unionByName, covered, dealt.mapInPandas(_judged(length), _SPAN))
    spans = found.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.col("mark").alias("key_mark")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, raw, a, b in zip(pdf["doc_id"], pdf["raw"], pdf["covered"], pdf["spans"], strict=True):
                every = [(x["start"], x["stop"]) for got in (a, b) if got is not None for x in got]
                rows.append((None if pd.isna(doc) else int(doc), *_digest(raw, every)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rest = pending.join(spans, (F.coalesce(pending["doc_id"], F.lit(NO_ID)) == spans["key"]) & (pending["mark"] == spans["key_mark"]), "left")
    done = state.filter("raw IS NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(rest.select("doc_id", "raw", "covered", "spans").mapInPandas(finish, result))
