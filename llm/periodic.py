"""Periodic runs of words: maximal stretches in which the words repeat with a period.

A run of period p and three periods or more holds three multiples of p one after another, whatever its start.
So questions are asked on the grid of multiples only, for each p up to a third of the text: n * log(n) places in
all. A grid place that agrees with the next two, and for a few words after them, is extended to both sides by
common extensions of a difference cover (``cover_lce``). Of one stretch found under several periods the
smallest counts, since a stretch with a multiple of its period is the same maximal stretch.

Nulls and ties: null, empty and blank texts have no words and no runs. Rows are taken one by one, so repeated rows
each get their result. Further columns are not read. A text is one piece of work, however long: some
hundred bytes of memory a word. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import text as T
from llm.cover_lce import CoverLCE
from llm.word_codes import joined, word_codes

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _grid(count: np.ndarray, first: np.ndarray, periods: int, most: int = 1 << 22):
    """In parts: text, place and period of every grid place that has two more after it in its text."""
    texts = np.repeat(np.arange(len(count)), count // periods)
    begin = np.cumsum(count // periods) - count // periods
    period = np.arange(len(texts)) - begin[texts] + 1
    places = (count[texts] - 1) // period - 1
    stop = np.cumsum(places)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(stop, (stop[at - 1] if at else 0) + most, "right")), at + 1)
        n = places[at:to]
        p = np.repeat(period[at:to], n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.repeat(texts[at:to], n)
        yield text, first[text] + nth * p, p
        at = to


def _candidates(codes, count, first, periods, few):
    """Grid places whose word returns one and two periods on, and whose next ``few`` words return too."""
    found = []
    for text, x, p in _grid(count, first, periods):
        live = np.flatnonzero(codes[x] == codes[x + p])
        live = live[codes[x[live] + p[live]] == codes[x[live] + 2 * p[live]]]
        for step in range(1, few):
            on = p[live] >= step  # beyond that, the words are compared already
            same = np.ones(len(live), bool)
            here = live[on]
            same[on] = codes[x[here] + step] == codes[x[here] + p[here] + step]
            live = live[same]
        found.append((text[live], x[live], p[live]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def find_runs(codes: np.ndarray, first: np.ndarray, least: int = 24, periods: int = 3, few: int = 8):
    """Runs of several texts given as word codes: text, start, length and period, by text, start and period."""
    count = np.diff(first)
    text, x, p = _candidates(codes, count, first, periods, few)
    asked = np.unique(text)
    if not len(asked):
        return [np.zeros(0, np.int64)] * 4
    # The texts that are asked about, one after another, each behind a symbol of its own.
    size = count[asked] + 1
    begin = np.cumsum(size) - size
    total = int(size.sum())
    string = np.empty(total + 1, np.int64)
    mark = np.zeros(total + 1, bool)
    mark[begin] = mark[total] = True
    inner = np.arange(total) - np.repeat(begin + 1 - first[asked], size)
    string[~mark] = codes[inner[~mark[:total]]] + len(asked) + 2
    string[mark] = np.arange(1, len(asked) + 2)
    of = np.searchsorted(asked, text)
    shift = begin[of] + 1 - first[text]
    x = x + shift
    to_right, pick, ahead = CoverLCE(string), [], []
    for at in range(0, len(x), 1 << 20):
        now, period = x[at : at + (1 << 20)], p[at : at + (1 << 20)]
        agreed = to_right(now, now + period)
        # Three grid places lie in a run, so from the first of them more than a period agrees.
        long_ = np.flatnonzero(agreed > period)
        end = now[long_] + period[long_] + agreed[long_]
        order = np.lexsort((now[long_], end, period[long_]))
        ends, its = end[order], period[long_][order]
        one = np.ones(len(order), bool)  # one place for each period and end
        one[1:] = (ends[1:] != ends[:-1]) | (its[1:] != its[:-1])
        pick.append(at + long_[order[one]])
        ahead.append(agreed[long_[order[one]]])
    pick, ahead = np.concatenate(pick), np.concatenate(ahead)
    of, x, p = of[pick], x[pick], p[pick]
    mirrored = CoverLCE(string[::-1])
    back = mirrored(total - (x - 1), total - (x + p - 1)) if len(x) else x
    start, length = x - back, back + ahead + p
    keep = length >= np.maximum(least, periods * p)
    of, start, length, p = of[keep], start[keep], length[keep], p[keep]
    order = np.lexsort((p, length, start))
    of, start, length, p = of[order], start[order], length[order], p[order]
    smallest = np.ones(len(p), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of, start, length, p = of[smallest], start[smallest], length[smallest], p[smallest]
    text, start = asked[of], start - begin[of] - 1
    order = np.lexsort((p, start, text))
    return [c[order] for c in (text, start, length, p)]


def periodic_runs(docs: DataFrame, least: int = 24, periods: int = 3, part_bytes: int = 4 << 20) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs`` by start and period, and ``collapsed``.

    A run has ``least`` words and ``periods`` periods at least (three periods or more), and no neighbouring word goes on
    with it. ``collapsed`` holds the words that no run contains after its first period, with one space between them.
    """
    if periods < 3:
        raise ValueError("a run holds three periods at least")

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                words = word_codes(part.column("text"))
                text, start, length, period = find_runs(words.codes, words.first, least, periods)
                change = np.zeros(len(words.codes) + 1, np.int64)
                at = words.first[text] + start
                np.add.at(change, at + period, 1)
                np.add.at(change, at + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                stops = np.zeros(len(words.first), np.int32)
                np.cumsum(np.bincount(text, minlength=len(words.first) - 1), out=stops[1:])
                runs = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.count), pa.ListArray.from_arrays(pa.array(stops), runs), joined(words, keep).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def planted(key: str = "doc_id", text: str = "text") -> Column:
    """The text with words that repeat from some place on, in one of ten rows by the hash of its key; others as they are.

    Texts without words, nulls and rows without key are never changed.
    """
    hashed = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[ \t-\r]+"), lambda w: w != "")
    parts = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).alias("n"), F.floor(hashed / 10).alias("g")))
    parts = F.transform(parts, lambda s: F.struct(s.w.alias("w"), s.n.alias("n"), F.pmod(s.g, s.n).alias("a"), s.g.alias("g")))
    parts = F.transform(parts, lambda s: F.struct(
        s.w.alias("w"), s.n.alias("n"), s.a.alias("a"), (1 + F.floor((s.n - s.a) / (3 + F.pmod(s.g, F.lit(8))))).alias("p")
    ))
    place = lambda s, i: F.when(i < s.a, i).otherwise(s.a + F.pmod(i - s.a, s.p))
    again = F.transform(parts, lambda s: F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0).cast("long"), (s.n - 1).cast("long")), lambda i: F.get(s.w, place(s, i).cast("int"))
    )))
    blank = ~F.col(text).rlike(r"[^ \t-\r]")
    return F.when((hashed % 10 != 0) | F.isnull(hashed) | blank | F.isnull(text), F.col(text)).otherwise(F.get(again, F.lit(0)))


def digests(found: DataFrame) -> DataFrame:
    """The strongest run of each row, and digests of its runs and of the collapsed text."""
    stronger = lambda a, r: F.isnull(a) | (r.length * a.period > a.length * r.period)  # noqa: E731  runs come by start, then period
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda a, r: F.when(stronger(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws("", r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
