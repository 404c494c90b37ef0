"""Periodic run detection by string synchronising sets (operator 11).

A run is a stretch of words with smallest period q that is at least 2 q (and ``least``) words long and
that no neighbouring word extends.  All runs of a text are found in time that grows like n log n:

1. Small periods.  For each period below ``3 * first`` the words are compared with themselves at that
   lag; long stretches of equality are runs.
2. Dyadic scales tau = ``first``, 2 ``first``, ...: each finds the periods from 3 tau to 6 tau - 1.
   Position i is synchronising if, among the hashes of the tau-word windows that start in i .. i + tau,
   the least is that of i or of i + tau; windows of period tau / 3 or less (they lie in runs found
   before) take no part.  So equal contexts of 2 tau words are chosen alike wherever they stand, the
   positions are few, and only highly periodic stretches have none.
3. Two synchronising positions with the same context, 3 tau to 6 tau - 1 apart, propose their distance;
   a stretch that matches itself at that distance for at least as long is a run.  A context is not
   highly periodic, so it returns at most 18 times within that reach.
4. A run whose first period is itself highly periodic may hold no such pair.  It then spans two runs
   of one small period p that touch and whose phases fit; these propose the omitted periods.

A stretch found with several periods keeps the smallest.  All texts of a part are worked on at once,
separated by codes of their own; at each scale only those long enough go on.

Defined cases: null or empty texts and texts without words have no runs and collapse to the empty
string; a null id is read unchanged; repeated rows each get their result; an empty table gives an
empty result; extra columns are ignored.  One text is worked on in one task, in memory that grows
with its length.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm import rolling
from actuaria.llm.common import in_parts, power_of_two, read

#: Least words of a run, first scale, bytes of texts that are worked on at a time.
LEAST, FIRST, SLICE = 12, 4, 1 << 20

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

Rearrange = Callable[[object, int], "np.ndarray | None"]


# ---- words

def word_codes(texts: list[bytes], order: Callable[[int, int], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): a 64-bit code per word, after each text one code of its own; where each text begins.

    ``order(k, n)`` may give other positions whose words the k-th text of n words is read as."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))  # word starts and ends in turn
    begin, end = edge[::2], edge[1::2]
    words = rolling.Prefixes(raw, least=SLICE)(begin, end)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    bound = np.searchsorted(begin, first)
    count = np.diff(bound)
    starts = np.concatenate([[0], np.cumsum(count + 1)])
    codes = np.empty(starts[-1], dtype=np.uint64)
    codes[starts[1:] - 1] = rolling.mix(np.arange(1, len(texts) + 1, dtype=np.uint64) * _LEFT)
    codes[np.arange(len(words)) + np.repeat(np.arange(len(texts)), count)] = words
    for k, n in enumerate(count.tolist()):
        other = order(k, n)
        if other is not None:
            codes[starts[k]:starts[k] + n] = words[bound[k] + other]
    return codes, starts


# ---- runs

class Runs(dict):
    """{(start, end): smallest period found}."""

    def add(self, start: int, end: int, period: int) -> None:
        if period < self.get((start, end), end):
            self[start, end] = period

    def up_to(self, period: int, length: int) -> np.ndarray:
        """(n, 3) starts, ends and periods of the runs of at most that period and at least that length."""
        rows = [(s, e, p) for (s, e), p in self.items() if p <= period and e - s >= length]
        return np.array(rows, dtype=np.int64).reshape(-1, 3)


def small_periods(codes: np.ndarray, below: int, least: int, runs: Runs) -> None:
    """Runs of periods below ``below``, also short ones that later scales must know as highly periodic."""
    for p in range(1, min(below, len(codes))):
        long = max(2 * p, min(least, power_of_two(3 * p))) - p
        stop = np.append(np.flatnonzero(codes[:-p] != codes[p:]), len(codes) - p)
        start = np.append(0, stop[:-1] + 1)
        for k in np.flatnonzero(stop - start >= long):
            runs.add(int(start[k]), int(stop[k]) + p, p)


def stretch(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest range around ``at`` whose words equal those ``lag`` further on."""
    right, step = at, 64
    while True:
        n = min(step, len(codes) - lag - right)
        same = codes[right:right + n] == codes[right + lag:right + lag + n]
        if n <= 0 or not same.all():
            right += int(np.argmin(same)) if n > 0 else 0
            break
        right, step = right + n, 2 * step
    left, step = at, 64
    while True:
        n = min(step, left)
        same = codes[left - n:left] == codes[left - n + lag:left + lag]
        if n <= 0 or not same.all():
            left -= int(np.argmin(same[::-1])) if n > 0 else 0
            break
        left, step = left - n, 2 * step
    return left, right


def verify(codes: np.ndarray, at: np.ndarray, lag: np.ndarray, runs: Runs) -> None:
    """Runs among the proposals (position, period); each stretch is looked at once."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(lag)) + 1):
        if not len(group):
            continue
        d, places, k = int(lag[group[0]]), at[group], 0
        while k < len(places):
            left, right = stretch(codes, int(places[k]), d)
            if right - left >= d:
                runs.add(left, right + d, d)
            k = max(k + 1, int(np.searchsorted(places, right)))


def synchronising(names: np.ndarray, tau: int) -> np.ndarray:
    """Positions whose own or tau-later window has the least name of all windows from the one to the other."""
    least, k = names, 1
    while k < tau:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == names[:n]) | (least == names[tau:tau + n])) & (least != _NEVER))


def equal_contexts(places: np.ndarray, context: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of the pairs with equal contexts that are at least ``near`` and less than ``far`` apart."""
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    at, lag, k = [], [], 1
    while k < len(places):
        close = np.flatnonzero((context[k:] == context[:-k]) & (places[k:] - places[:-k] < far))
        if not len(close):
            break
        distance = places[close + k] - places[close]
        fits = distance >= near
        at.append(places[close[fits]])
        lag.append(distance[fits])
        k += 1
    return (np.concatenate(at), np.concatenate(lag)) if at else (places[:0], places[:0])


def omitted(codes: np.ndarray, known: np.ndarray, near: int, far: int) -> Iterator[tuple[int, int]]:
    """(position, period) of squares whose halves lie in two touching runs of one small period."""
    known = known[np.lexsort((known[:, 0], known[:, 2]))]
    for (s1, e1, p), (s2, e2, p2) in zip(known[:-1].tolist(), known[1:].tolist()):
        if p != p2 or not s1 < s2 <= e1:
            continue
        tail, root = codes[e1 - 2 * p + 1:e1].tobytes(), codes[s2:s2 + p].tobytes()
        at = tail.find(root)
        while at % 8 and at >= 0:  # codes are eight bytes
            at = tail.find(root, at + 1)
        if at < 0:
            continue
        q = s2 - (e1 - 2 * p + 1 + at // 8)
        q += -(-(near - q) // p) * p  # the least period of that phase within reach
        while q < far:
            start = max(s1, s2 - q)
            if start <= min(e1 - q, e2 - 2 * q):
                yield start, q
            q += p


def runs_of(codes: np.ndarray, starts: np.ndarray, least: int = LEAST, first: int = FIRST) -> Runs:
    """All runs of texts of codes, as positions in ``codes``; also some shorter than ``least``."""
    runs = Runs()
    small_periods(codes, 3 * first, least, runs)
    length = np.diff(starts) - 1
    place = np.arange(len(codes))
    names, tau = codes, 1
    while True:
        if tau >= first:
            keep = length >= 6 * tau  # a square of a period of 3 tau must fit
            if not keep.any():
                return runs
            if not keep.all():
                stays = np.repeat(keep, length + 1)
                place, names, length = place[stays], names[stays[:len(names)]], length[keep]
        n = len(place)
        if len(names) < n:  # windows that would reach beyond the end
            names = np.append(names, np.full(n - len(names), _NEVER))
        longer = rolling.mix(names[:-tau] * _LEFT + rolling.mix(names[tau:]) * _RIGHT) if n > tau else names[:0]
        if tau >= first:
            scale(codes, place, names, longer, tau, runs)
        names, tau = longer, 2 * tau


def scale(codes: np.ndarray, place: np.ndarray, names: np.ndarray, longer: np.ndarray, tau: int, runs: Runs) -> None:
    """Runs of periods from 3 tau to 6 tau - 1."""
    known = runs.up_to(tau // 3, tau)
    own = names
    if len(known):
        at = np.searchsorted(place, known[:, 0])
        here = at < len(place)
        here[here] = place[at[here]] == known[here, 0]
        at, known = at[here], known[here]
        step = np.zeros(len(place) + 1, dtype=np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + known[:, 1] - known[:, 0] - tau + 1, -1)
        own = names.copy()
        own[np.cumsum(step[:-1]) > 0] = _NEVER
    chosen = synchronising(own, tau)
    chosen = chosen[chosen < len(longer)]
    at, lag = equal_contexts(chosen, longer[chosen], 3 * tau, 6 * tau)
    verify(codes, place[at], lag, runs)
    extra = list(omitted(codes, known[known[:, 1] - known[:, 0] >= 3 * tau], 3 * tau, 6 * tau))
    if extra:
        verify(codes, *np.array(extra, dtype=np.int64).T, runs)


# ---- the operator

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(raw: bytes, other: np.ndarray | None, spans: list[tuple[int, int, int]]) -> bytes:
    words = raw.split()  # ASCII white space
    if other is not None:
        words = [words[i] for i in other.tolist()]
    if spans:
        step = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in spans:
            step[start + period] += 1
            step[start + length] -= 1
        words = [w for w, gone in zip(words, np.cumsum(step).tolist()) if not gone]
    return b" ".join(words)


def find_runs(ids: list, texts: list[bytes], least: int = LEAST, rearrange: Rearrange | None = None,
              first: int = FIRST) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text its runs (start, length, period) by start, and the text collapsed to the first period of each run."""
    others: dict[int, np.ndarray] = {}

    def order(k: int, n: int) -> np.ndarray | None:
        other = rearrange(ids[k], n) if rearrange else None
        if other is not None:
            others[k] = other
        return other

    codes, starts = word_codes(texts, order)
    found: dict[int, list] = {}
    rows = [(s, e, p) for (s, e), p in runs_of(codes, starts, least, first).items() if e - s >= max(least, 2 * p)]
    for (s, e, p), k in zip(rows, np.searchsorted(starts, [r[0] for r in rows], side="right") - 1):
        found.setdefault(int(k), []).append((s - int(starts[k]), e - s, p))
    return [(sorted(found.get(k, ()), key=lambda r: (r[0], r[2])), _collapsed(t, others.get(k), found.get(k, ())))
            for k, t in enumerate(texts)]


def _find_rows(least: int, rearrange: Rearrange | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 512):
            ids = batch.column("id").to_pylist()
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            size = np.cumsum([len(t) + 1 for t in texts]) // SLICE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1):
                lo, hi = int(part[0]), int(part[-1]) + 1
                got = find_runs(ids[lo:hi], texts[lo:hi], least, rearrange)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in spans] for spans, _ in got], _RUN)
                kept = pa.array([c for _, c in got], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), runs, kept],
                                                 names=["id", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST,
                  rearrange: Rearrange | None = None) -> DataFrame:
    """id, runs (start, length, period in words, by start) and the collapsed text of every row."""
    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        _find_rows(least, rearrange), f"id {kind}, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id)


# ---- the query

def planted(id: object, n: int) -> np.ndarray | None:
    """In every tenth document (by the hash of its id) the words from one place on repeat with one period."""
    h = zlib.crc32(str(id).encode()) if id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def run_digests(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one and digests of runs and collapsed texts."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    return found.select(
        id, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def runs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table, every tenth text read with a period planted in it."""
    return run_digests(periodic_runs(read(spark, sf_dir, "documents", "doc_id", "text"), rearrange=planted))
