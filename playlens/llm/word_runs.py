"""Periodic runs of words, found by minimizers at doubling scales.

A run is a stretch of words with smallest period q, at least ``max(12, 2 q)`` words long, that can't be made longer.
Periods under ``SHORT`` are found by a direct scan of each lag. For the others a scale w = 16, 32, 64, … serves the periods
from w up to 2 w: grams of w/2 words are hashed, and the least hash of every w/2 grams in a row is marked. The words of such
a window come again one period later, so inside a run a marked gram is marked again at distance q. Equal marks at a distance
of w to 2 w are seeds; a seed is lengthened word by word on both sides, which also verifies it, so hashes never decide.

Marks that follow each other within w/4 lie in a run of a short period of their own; of these only the first and the last
are kept (the run of period q can't hold more than q + w/4 words of it, so one of its ends comes again), and so a mark
has at most a fixed number of partners, whatever the text. A seed inside a stretch of its lag that is known is skipped.
A stretch that is also found with a smaller period is that one's run.

Documents are worked on in blocks of many words, set apart by words that occur nowhere else; a document stays in one block.
Null texts have no words; a null id is hashed as the empty text; rows that repeat are worked out each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from playlens.llm.common import text_of

LEAST = 12
SHORT = 16
#: Words of the documents that are worked on together; one document may be longer.
BLOCK = 200_000

_WORD = re.compile(r"[^ \t-\r]+")
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` (a power of two) values in a row."""
    step = 1
    while step < width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def _stretches(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of all longest stretches whose words are equal at ``lag``."""
    same = np.zeros(len(words) - lag + 2, np.int8)
    same[1:-1] = words[lag:] == words[:-lag]
    edge = np.flatnonzero(np.diff(same))
    return edge[::2], edge[1::2] - edge[::2] + lag


def _thinned(at: np.ndarray, gram: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks by gram and place; of equal ones that follow each other within ``near`` only the first and the last."""
    order = np.lexsort((at, gram))
    at, gram = at[order], gram[order]
    joined = (gram[1:] == gram[:-1]) & (at[1:] - at[:-1] <= near)
    keep = ~(np.append(joined, False) & np.append(False, joined))
    return at[keep], gram[keep]


def _extended(words: np.ndarray, at: int, lag: int, low: int) -> tuple[int, int]:
    """The stretch of ``lag`` around the equal words at ``at`` and ``at + lag``, not in front of ``low``."""
    n, step, end = len(words), 32, at
    while end + lag < n:
        other = np.flatnonzero(words[end : end + step][: n - lag - end] != words[end + lag : end + lag + step])
        if len(other):
            end += int(other[0])
            break
        end, step = min(end + step, n - lag), step * 2
    step, start = 32, at
    while start > low:
        first = max(low, start - step)
        other = np.flatnonzero(words[first:start] != words[first + lag : start + lag])
        if len(other):
            start = first + int(other[-1]) + 1
            break
        start, step = first, step * 2
    return start, end + lag - start


def _seeds(words: np.ndarray, hashes: np.ndarray, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags of equal marked grams at a distance of w up to 2 w; ``hashes`` are of grams of w/2 words."""
    values = _mixed(hashes)
    least = _least(values, w // 2)
    # a gram is marked if it is the least of a window that holds it: the greatest of its windows' leasts is its own value
    most = ~_least(~np.concatenate([np.zeros(w // 2 - 1, np.uint64), least, np.zeros(w // 2 - 1, np.uint64)]), w // 2)
    marked = most == values
    at = np.flatnonzero(marked)
    at, gram = _thinned(at, values[at], w // 4)
    for k in range(1, len(at)):
        ahead = (gram[k:] == gram[:-k]) & (at[k:] - at[:-k] < 2 * w)
        if not ahead.any():
            break
        fits = ahead & (at[k:] - at[:-k] >= w)
        yield at[:-k][fits], (at[k:] - at[:-k])[fits]


def find(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, none of whose runs is longer than ``longest``."""
    found: dict[tuple[int, int], int] = {}

    def add(start: int, length: int, lag: int) -> None:
        if length >= max(LEAST, 2 * lag):
            at = (start, length)
            found[at] = min(lag, found.get(at, lag))

    for lag in range(1, min(SHORT, longest // 2 + 1)):
        start, length = _stretches(words, lag)
        for i in np.flatnonzero(length >= max(LEAST, 2 * lag)):
            add(int(start[i]), int(length[i]), lag)
    w, grams, times = SHORT, words.astype(np.uint64), _TIMES
    with np.errstate(over="ignore"):
        grams = _mixed(grams + _TIMES)
        for step in (1, 2, 4):  # grams of 8 words
            grams, times = grams[:-step] * times + grams[step:], times * times
        while 2 * w <= longest:
            places, lags = [], []
            for at, lag in _seeds(words, grams, w):
                places.append(at)
                lags.append(lag)
            if places:
                at, lag = np.concatenate(places), np.concatenate(lags)
                order = np.lexsort((at, lag))
                known, until = 0, 0
                for m, d in zip(at[order].tolist(), lag[order].tolist(), strict=True):
                    if d != known:
                        known, until = d, 0
                    if m < until or words[m] != words[m + d]:
                        continue
                    start, length = _extended(words, m, d, until)
                    until = start + length - d
                    add(start, length, d)
            grams, times = grams[: -w // 2] * times + grams[w // 2 :], times * times
            w *= 2
    return sorted((start, length, lag) for (start, length), lag in found.items())


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words, or for ids whose crc32 ends in 0 those with a tail of copies."""
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without all but the first period of each run."""
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d] if runs else words


def _block(own: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some lists of words."""
    numbers: dict[str, int] = {}
    number = numbers.setdefault
    sizes = np.array([len(w) for w in own])
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.empty(int(sizes.sum()) + len(own), np.int64)
    for at, words in zip(starts.tolist(), own, strict=True):
        flat[at : at + len(words)] = [number(w, len(numbers)) for w in words]
    flat[starts + sizes] = -1 - np.arange(len(own))
    out: list[list[tuple[int, int, int]]] = [[] for _ in own]
    todo = np.argsort(sizes, kind="stable")
    while len(todo):  # long documents need more scales than short ones: those of one magnitude together
        longest = 4 * max(int(sizes[todo[0]]), SHORT)
        now = todo[sizes[todo] <= longest]
        todo = todo[len(now) :]
        here = np.concatenate([flat[starts[d] : starts[d] + sizes[d] + 1] for d in now.tolist()])
        first = np.append(0, np.cumsum(sizes[now] + 1))
        for start, length, period in find(here, int(sizes[now[-1]])):
            k = int(np.searchsorted(first, start, "right")) - 1
            out[now[k]].append((start - int(first[k]), length, period))
    return out


RUNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def _row(doc: int | None, words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    text = " ".join(collapsed(words, runs))
    exponent = 1000 * best[1] // best[2] if runs else None
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, text)]
    return (doc, len(runs), *best, exponent, *shas, [{"start": s, "length": n, "period": q} for s, n, q in runs], text)


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: its number of runs, the longest one, digests of all runs and of the text without repeated
    periods, the runs themselves and that text. With ``plant`` every tenth document's tail is made periodic first."""
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", RUNS)]
    whole = {c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")}

    def out(held: list[tuple[int | None, list[str]]]) -> pd.DataFrame:
        runs = _block([w for _, w in held])
        rows = [_row(doc, words, own) for (doc, words), own in zip(held, runs, strict=True)]
        return pd.DataFrame(rows, columns=names).astype(whole)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                doc, words = None if pd.isna(doc) else int(doc), _WORD.findall(text)
                held.append((doc, planted(words, doc) if plant else words))
                size += len(words)
                if size >= BLOCK:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, RUNS)
