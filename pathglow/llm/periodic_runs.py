"""Periodic runs: stretches of words that repeat a shorter stretch, found in tiles that are scaled to the period.

A run is a maximal stretch of consecutive words with smallest period q and at least ``max(LEAST_WORDS, LEAST_TIMES * q)``
words. Periods fall into octaves: octave k holds those from 2^k to 2^(k+1) - 1. A document is exploded into tiles that overlap:
one set of tiles of ``CORE`` words serves the octaves up to ``LOW``, each higher octave has tiles of 8 * 2^k words; a tile
sees 2^k words before and 4 * 2^k words behind those that it owns. In a tile a boundary stands every 2^k words. A run of the
octave holds boundaries b at which the 2^k words from b equal those from b + q, and two that are neighbours; hashes of such
grams screen the pairs (b, q), and false ones only cost time. At the boundaries left, Z-functions of the words to the right
and of the mirrored words to the left tell exactly how far the period reaches within the tile. Periods whose root is itself a
repetition are dropped. The fragments, intervals with a period, are merged in the tile, shuffled by document and period, and
those that share a period's words or more are stitched; what is long enough then is a run.

Documents of up to ``CORE`` words are one tile, solved where they are read. The tiles of longer ones are dealt over all tasks,
so one long text is not one task's work. The fragments of one period of one document meet in one task; they are merged
before, so there are at most a few for every ``CORE`` words.

Defined cases: null and empty texts have no runs, and an empty collapsed text; repeated rows and null ids are returned as
they come; an empty table gives no rows; columns other than the id and the text are ignored, whatever their names. Of runs
with the same length divided by period (in doubles, exact below some 50 million words) the one that starts first is the best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglow.llm.common import drop_held, parts, split_words, text_column, written

LEAST_WORDS, LEAST_TIMES = 6, 4
CORE, LOW = 16_384, 11
#: Pairs of positions that are compared at once.
AT_ONCE = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)

Fragments = list[tuple[int, int, int, int]]


def z_function(s: list[int], upto: int) -> list[int]:
    """For the first ``upto`` places, how many elements from there on equal those from the beginning on."""
    n, left, right = len(s), 0, 0
    z = [0] * min(upto, n)
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _is_repetition(p: int, z: list[int]) -> bool:
    """Whether the first p elements are a shorter root repeated."""
    rest, r = p, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            if z[p // r] >= p - p // r:
                return True
            while rest % r == 0:
                rest //= r
        r += 1
    return False


def _hits(codes: np.ndarray, grams: np.ndarray, end: np.ndarray, owned: np.ndarray, place: np.ndarray, inner: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of one octave whose grams are equal, in order; single ones away from a tile's edges go."""
    n, here = len(codes), np.flatnonzero(owned & (place & (step - 1) == 0))
    here = here[here + 2 * step <= end[here]]
    periods, found = np.arange(step, 2 * step), []
    for rows in np.array_split(here, max(1, len(here) * step // AT_ONCE)):
        then = rows[:, None] + periods
        same = (grams[np.minimum(then, n - 1)] == grams[rows][:, None]) & (then + step <= end[rows][:, None])
        i, j = np.nonzero(same)
        found.append((rows[i], periods[j]))
    b, p = (np.concatenate(x) for x in zip(*found, strict=True))
    key = np.sort(p * np.int64(2 * n) + b)

    def beside(by: int) -> np.ndarray:
        want = p * np.int64(2 * n) + b + by
        return key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want

    if len(b):
        keep = beside(step) | beside(-step) | (inner[b] < step)
        b, p = b[keep], p[keep]
    return b, p


def merged(fragments: Fragments) -> Fragments:
    """Fragments (owner, period, start, stop) of the same owner and period that share a period's words or more, as one."""
    out: Fragments = []
    for owner, p, start, stop in sorted(fragments):
        if out and out[-1][:2] == (owner, p) and start + p <= out[-1][3]:
            out[-1] = (owner, p, out[-1][2], max(stop, out[-1][3]))
        else:
            out.append((owner, p, start, stop))
    return out


def solve_tiles(codes: np.ndarray, counts: np.ndarray, base: np.ndarray, own_from: np.ndarray, own_to: np.ndarray, low: int, high: int) -> Fragments:
    """Fragments (tile, period, start, stop) of many tiles, their words one after the other; places count in the document.

    ``base`` is the place of a tile's first word, ``own_from`` and ``own_to`` bound the boundaries that are its own.
    Fragments that are too short for a run, and cannot go on in another tile, are left out.
    """
    n = len(codes)
    if not n:
        return []
    first = np.cumsum(counts) - counts
    tile = np.repeat(np.arange(len(counts)), counts)
    end, begin = np.repeat(first + counts, counts), np.repeat(first, counts)
    place = np.arange(n) - begin + np.repeat(base, counts)
    edge_from, edge_to = np.repeat(own_from, counts), np.repeat(own_to, counts)
    owned = (place >= edge_from) & (place < edge_to)
    # words between a boundary and the nearest edge behind which the same document goes on in another tile; without one, many
    inner = np.minimum(np.where(edge_from > 0, place - edge_from, n), np.where(np.repeat(own_to < base + counts, counts), edge_to - place - 1, n))
    grams = (codes.astype(np.uint64) + np.uint64(1)) * _PRIME
    kept: Fragments = []
    known = np.zeros(n, np.int64)  # at a word of a run of an octave before: where that run ends, less its period
    most = int(counts.max())
    for k in range(high + 1):
        step = 1 << k
        if 2 * step > most:
            break
        if k >= low:
            b, p = _hits(codes, grams, end, owned, place, inner, step)
            found: Fragments = []
            cuts = np.flatnonzero(np.r_[True, np.diff(b) != 0]) if len(b) else []
            # hits come by boundary within a chunk, and chunks in order of boundaries
            for at, then in zip(cuts, [*cuts[1:], len(b)], strict=True) if len(b) else ():
                x, ps = int(b[at]), p[at:then]
                if known[x] - x >= 2 * step:
                    continue  # a run of a shorter period covers all that these periods could
                top, stop = int(ps.max()), int(end[x])
                right = codes[x : min(x + 4 * step, stop)].tolist()
                z = z_function(right, top + 1)
                back = codes[max(int(begin[x]), x - step) : x][::-1].tolist()
                left = z_function([*back, -1, *right[:top][::-1]], len(back) + 1 + top)
                for q in ps.tolist():
                    if not _is_repetition(q, z):
                        reach = left[len(back) + 1 + top - q]
                        found.append((int(tile[x]), q, x - reach, x + q + z[q]))
            found = merged(found)
            if k < high:
                for _, q, s, e in found:
                    known[s:e] = np.maximum(known[s:e], e - q)
            for t, q, s, e in found:
                at = int(base[t]) - int(first[t])
                s, e = s + at, e + at
                open_ended = (own_from[t] > 0 and s <= own_from[t]) or (own_to[t] < base[t] + counts[t] and e >= own_to[t])
                if open_ended or e - s >= max(LEAST_WORDS, LEAST_TIMES * q):
                    kept.append((t, q, s, e))
        if k < high:
            grams = np.r_[(grams[: max(n - step, 0)] ^ (grams[: max(n - step, 0)] >> np.uint64(29))) * _PRIME + grams[step:], np.zeros(min(step, n), np.uint64)]
    return kept


def tiles(n: int, core: int = CORE, low: int = LOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The tiles of a document of n words: lowest and highest octave, first and last word seen, first and last word owned."""
    for a in range(0, n, core):
        yield 0, low, max(0, a - (1 << low)), min(n, a + core + (4 << low)), a, min(n, a + core)
    k = low + 1
    while LEAST_TIMES << k <= n:
        for a in range(0, n, 8 << k):
            yield k, k, max(0, a - (1 << k)), min(n, a + (12 << k)), a, min(n, a + (8 << k))
        k += 1


_FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_TILE = "low int, high int, base long, own_from long, own_to long, codes binary"


def _lists(rows: list[Fragments], kind: pa.DataType = _FRAGMENT) -> pa.Array:
    return pa.array([[{"period": p, "start": s, "stop": e} for _, p, s, e in r] for r in rows], pa.list_(kind))


def _read(part: pa.RecordBatch, core: int, low: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents, with the fragments of those that are one tile, and rows of the tiles of the others."""
    words, counts = split_words(text_column(part, "text"))
    coded = pc.dictionary_encode(words)
    codes = coded.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    small = np.flatnonzero(counts <= core)
    mine = np.repeat(counts <= core, counts)
    found: list[Fragments] = [[] for _ in range(len(counts))]
    zero = np.zeros(len(small), np.int64)
    for f in solve_tiles(codes[mine], counts[small], zero, zero, counts[small], 0, max(low, core.bit_length())):
        found[small[f[0]]].append(f)
    pending = np.array([bool(f) for f in found], bool) | (counts > core)
    texts = pc.binary_join(pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), words), pa.scalar(" ", words.type))
    _, offsets, data = texts.buffers()
    bounds, data = np.frombuffer(offsets, np.int64).tolist(), memoryview(data or b"")
    digests = [None if p else hashlib.sha256(data[bounds[i] : bounds[i + 1]]).hexdigest() for i, p in enumerate(pending.tolist())]
    joined = pc.if_else(pa.array(pending), texts.cast(pa.string()), pa.scalar(None, pa.string()))
    rows = part.num_rows
    none = [pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    names = ["row", "id", "words", "digest", "fragments", "low", "high", "base", "own_from", "own_to", "codes"]
    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), joined, pa.array(digests, pa.string()), _lists(found), *none], names)
    for i in np.flatnonzero(counts > core).tolist():
        a = int(first[i])
        for lo, hi, seen, until, own, own_to in tiles(int(counts[i]), core, low):
            values = [[lo], [hi], [seen], [own], [own_to], [codes[a + seen : a + until].astype(np.int32).tobytes()]]
            arrays = [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row").slice(i, 1), pa.nulls(1, part.column("id").type), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(_FRAGMENT)), *arrays], names)


def _solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for row, lo, hi, base, own, own_to, data in zip(*(batch.column(c).to_pylist() for c in ("row", "low", "high", "base", "own_from", "own_to", "codes")), strict=True):
        codes = np.frombuffer(data, np.int32).astype(np.int64)
        found = solve_tiles(codes, *(np.array([v], np.int64) for v in (len(codes), base, own, own_to)), lo, hi)
        yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3))], ["row", "period", "start", "stop"])


def _collapsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The digest of the words that are left when of each run only its first period is kept."""
    out = []
    for text, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
        words = text.split(" ") if text else []
        edge = np.zeros(len(words) + 1, np.int64)
        for r in runs or []:
            edge[r["start"] + r["period"]] += 1
            edge[r["start"] + r["length"]] -= 1
        kept = (np.cumsum(edge)[:-1] == 0).tolist()
        out.append(hashlib.sha256(" ".join(w for w, k in zip(words, kept, strict=True) if k).encode()).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "collapsed"])


def stitched(fragments: DataFrame) -> DataFrame:
    """row, start, length, period of the runs that fragments (row, period, start, stop) make together."""
    order = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("fresh", (reach.isNull() | (F.col("start") + F.col("period") > reach)).cast("int"))
    marked = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("row", "period", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period"))).select("row", "start", "length", "period")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, low: int = LOW) -> DataFrame:
    """``id_col``, runs (start, length, period; by start, then period), best and collapsed_sha256: one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for part in parts(batch, "text"):
                yield from _read(part, core, low)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _solve(batch)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "words"):
                yield _collapsed(part)

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = written(slim.mapInArrow(read, f"row long, id {kind}, words string, digest string, fragments array<struct<period long, start long, stop long>>, {_TILE}"), "period-tiles")
    here = seen.where("size(fragments) > 0").select("row", F.inline("fragments"))
    # a row is the work of one tile; tiles of one text are dealt to different tasks
    there = seen.where("codes is not null").select("row", "low", "high", "base", "own_from", "own_to", "codes").repartition("row", "low", "own_from")
    fragments = here.unionByName(there.mapInArrow(solve, "row long, period long, start long, stop long"))
    run = F.struct("start", "length", "period")
    better = F.struct((F.col("length") / F.col("period")).alias("times"), (-F.col("start")).alias("start"), (-F.col("period")).alias("period"))
    by_row = stitched(fragments).groupBy("row").agg(F.array_sort(F.collect_list(run)).alias("runs"), F.max_by(run, better).alias("best"))
    by_row = by_row.withColumn("runs", F.array_sort("runs", _by_start_and_period))
    pending = seen.where("codes is null and digest is null").select("row", "words")
    found = written(pending.join(by_row, "row", "left"), "period-runs")
    texts = found.select("row", "words", "runs").mapInArrow(collapse, "row long, collapsed string")
    more = found.select("row", "runs", "best").join(texts, "row")
    rows = seen.where("codes is null").select("row", F.col("id").alias(id_col), "digest").join(more, "row", "left")
    none = F.array().cast("array<struct<start long, length long, period long>>")
    return rows.select(id_col, F.coalesce("runs", none).alias("runs"), "best", F.coalesce("digest", "collapsed").alias("collapsed_sha256"))


def _by_start_and_period(a: Column, b: Column) -> Column:
    def sign(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.when(a["start"] != b["start"], sign(a["start"], b["start"])).otherwise(sign(a["period"], b["period"]))
