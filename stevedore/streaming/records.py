"""Counts of log records by window, with their continuation lines, over rolled files and micro-batches.

A log is a series of rolled files. A stack trace may begin in one file and go on in the next, which may
come in a later micro-batch; and a file may come when its windows have long been closed. Neither is lost here:
keyed state holds each series' last record and its open windows, and lines behind the watermark are given out as such.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stevedore.sources.logs import parse_logs
from stevedore.streaming.follow import _reader

_SUMMARY = "series STRING, place STRING, block LONG, event TIMESTAMP, win LONG, level STRING, n LONG, heads LONG, last LONG, last_level STRING"
_ARROW = pa.schema([
    ("series", pa.string()), ("place", pa.string()), ("block", pa.int64()), ("event", pa.timestamp("us", tz="UTC")), ("win", pa.int64()),
    ("level", pa.string()), ("n", pa.int64()), ("heads", pa.int64()), ("last", pa.int64()), ("last_level", pa.string()),
])


def rolled_from(path: Column) -> Column:
    """The path without the number or date of a rolled file: ``app.log.2024-05-01``, ``app-3.log`` -> ``app.log``."""
    return F.regexp_replace(path, r"[._-][0-9][0-9T:._-]*(?=(\.(log|txt|out))?$)", "")


def _summaries(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each split, in the task that reads it: lines by (window, level) of their record, the lines above its first
    record, its last record; and the greatest time as a row of its own, which alone drives the watermark."""

    def rows_of(split: dict) -> Iterator[dict]:
        same = {k: split[k] for k in ("series", "place", "block")}
        for (win, level), n in split["counts"].items():
            yield {**same, "win": win, "level": level, "n": n}
        yield {**same, "heads": split["heads"], "last": split["last"], "last_level": split["last_level"]}
        if split["event"] is not None:
            yield {**same, "event": split["event"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, split = None, None
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("split").to_numpy()
            times = batch.column("ts")
            timed, ts = times.is_valid().to_numpy(zero_copy_only=False), times.fill_null(0).to_numpy()
            levels = batch.column("level").dictionary_encode()
            names = [*levels.dictionary.to_pylist(), None]
            codes = levels.indices.fill_null(len(names) - 1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
            done = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at is None or ids[a] != at:
                    if split:
                        done.extend(rows_of(split))
                    at = ids[a]
                    split = {k: batch.column(k)[int(a)].as_py() for k in ("series", "place", "block")}
                    split |= {"counts": {}, "heads": 0, "last": None, "last_level": None, "event": None}
                places = np.flatnonzero(timed[a:b]) + a
                above = int(places[0] - a) if len(places) else int(b - a)  # lines of a record that an earlier batch holds
                counts = split["counts"]
                if above and split["last"] is not None:
                    key = (split["last"] // width * width, split["last_level"])
                    counts[key] = counts.get(key, 0) + above
                else:
                    split["heads"] += above
                if len(places):
                    lines = np.diff(np.append(places, b))
                    pairs, where = np.unique(np.stack([ts[places] // width * width, codes[places]]), axis=1, return_inverse=True)
                    for (win, code), n in zip(pairs.T.tolist(), np.bincount(where.ravel(), lines).tolist(), strict=True):
                        key = (win, names[code])
                        counts[key] = counts.get(key, 0) + int(n)
                    split["last"], split["last_level"] = int(ts[places[-1]]), names[codes[places[-1]]]
                    newest = int(ts[places].max())
                    split["event"] = newest if split["event"] is None else max(split["event"], newest)
            if done:
                yield pa.RecordBatch.from_pylist(done, _ARROW)
        if split:
            yield pa.RecordBatch.from_pylist(list(rows_of(split)), _ARROW)

    return run


def _fold(width: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """One series: gives lines above a split's first record to the record before it, closes windows, tells late lines."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"place": None, "last": None, "level": None, "open": []}
        opened = {(win, level): n for win, level, n in kept["open"]}
        now = state.getCurrentWatermarkMs() * 1000
        out = [(w, lv, n, False) for (w, lv), n in opened.items() if w + width <= now]
        opened = {(w, lv): n for (w, lv), n in opened.items() if w + width > now}
        fresh: dict[tuple[int | None, str | None], int] = {}

        def add(win: int | None, level: str | None, n: int) -> None:
            fresh[win, level] = fresh.get((win, level), 0) + n

        splits = []
        for frame in () if state.hasTimedOut else frames:
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if r["n"] is not None:
                    add(int(r["win"]), r["level"], int(r["n"]))
                elif r["heads"] is not None:
                    splits.append((r["place"], int(r["block"]), int(r["heads"]), r["last"], r["last_level"]))
        newest, file, carried = kept["place"], None, (kept["last"], kept["level"])
        own: tuple = (None, None)  # of a file that comes after its successors: what stood above it isn't known any more
        for place, _, heads, last, level in sorted(splits, key=lambda s: s[:2]):
            behind = newest is not None and place < newest
            if behind and place != file:
                own = (None, None)
            file = place
            owner = own if behind else carried
            if heads:
                add(None if owner[0] is None else owner[0] // width * width, owner[1], heads)
            if last is not None:
                own = (int(last), level)
                carried = carried if behind else own
            if not behind:
                kept["place"] = place
        for (win, level), n in fresh.items():
            if win is None or win + width <= now:
                out.append((win, level, n, win is not None))
            else:
                opened[win, level] = opened.get((win, level), 0) + n
        kept |= {"last": carried[0], "level": carried[1], "open": [[w, lv, n] for (w, lv), n in opened.items()]}
        state.update((json.dumps(kept),))
        if opened:
            state.setTimeoutTimestamp(max(now // 1000 + 1, min(w for w, _ in opened) // 1000 + width // 1000))
        if out:
            win, level, n, late = zip(*out, strict=True)
            yield pd.DataFrame({"series": key[0], "win": pd.array(win, "Int64"), "level": pd.array(level, object), "n": list(n), "late": list(late)})

    return run


def follow_records(
    spark: SparkSession,
    path: str,
    *,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    series: Callable[[Column], Column] = rolled_from,
    place: Callable[[Column], Column] | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming counts ``(series, window_start, window_end, level, n, late)`` of all lines under ``path``, for append mode.

    A line without a time (of a stack trace) counts as part of the record above it: in its window, at its level, also
    where that record is in an earlier file of the series or an earlier micro-batch. ``series`` tells from a file's path which log it
    is part of; ``place`` gives the text by which a log's files are ordered (default: modification time, then path).

    A window is given out once, when event time passes its end plus ``watermark``, with ``late`` false. Lines that come
    later are given out with ``late`` true, at once, as counts to be added. Lines that no record owns (above the first of
    a series, or above the first of a file that comes after its successors) have a NULL window. So the
    sum over all rows, once all windows are closed, is the count that a batch job gives.

    Lines are counted in the tasks that read them. What is shuffled, and meets the state, are a few rows for each split
    and window: no task gets a series' lines. The state of a series is its last record and its open windows.
    """
    width = int(pd.Timedelta(window).value // 1000)
    if width <= 0:
        raise ValueError(f"window must be longer than nothing, got {window!r}")
    lines = _reader(spark, path, max_files_per_trigger).select(
        "value",
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("modified"),
    )
    # ``parse_logs`` keeps source and place columns only: what it needn't know travels with the source.
    parsed = parse_logs(lines.select("value", F.struct("source", "modified").alias("source"), "block"))
    at = F.col("source.source")
    order = place(at) if place else F.concat_ws("|", "source.modified", at)
    compact = parsed.select(
        F.coalesce(series(at), F.lit("")).alias("series"),
        F.coalesce(order, F.lit("")).alias("place"),
        "block",
        F.xxhash64(at, "block").alias("split"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        "level",
    ).mapInArrow(_summaries(width), _SUMMARY)
    counted = (
        compact.withWatermark("event", watermark)  # NULL in all rows that count, or late ones would be dropped unseen
        .groupBy("series")
        .applyInPandasWithState(
            _fold(width), "series STRING, win LONG, level STRING, n LONG, late BOOLEAN", "kept STRING", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return counted.select(
        "series",
        F.timestamp_micros("win").cast("timestamp_ntz").alias("window_start"),
        F.timestamp_micros(F.col("win") + F.lit(width)).cast("timestamp_ntz").alias("window_end"),
        "level",
        "n",
        "late",
    )
