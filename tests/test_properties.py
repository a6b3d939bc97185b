"""Property tests: the keyed jobs against plain-Python models on random small tables."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stevedore.operators import merge_upsert, reconcile, snapshot_as_of

SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))

keys = st.one_of(st.none(), st.integers(0, 6))
target_rows = st.lists(st.tuples(keys, st.sampled_from("abc")), max_size=8)
source_rows = st.lists(st.tuples(keys, st.sampled_from("xyz"), st.booleans()), max_size=8)


def unique_complete_keys(rows):
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] in seen:
            continue
        seen.add(r[0])
        out.append(r)
    return out


def model_merge(target, source):
    """Every target row whose key a source row has is replaced (or deleted) by it;
    other target rows stay; source rows matching no target row insert (unless deleted)."""
    target_keys = {k for k, v in target if k is not None}
    by_key = {k: (v, d) for k, v, d in source if k is not None}
    out = []
    for k, v in target:
        if k is not None and k in by_key:
            new_v, gone = by_key[k]
            if not gone:
                out.append((k, new_v))
        else:
            out.append((k, v))
    out += [(k, v) for k, v, d in source if (k is None or k not in target_keys) and not d]
    return sorted(out, key=repr)


@SETTINGS
@given(target_rows, source_rows, st.booleans())
def test_merge_matches_model(spark, t_rows, s_rows, colocated):
    s_rows = unique_complete_keys(s_rows)
    target = spark.createDataFrame(t_rows, "k INT, v STRING")
    source = spark.createDataFrame(s_rows, "k INT, v STRING, d BOOLEAN")
    got = sorted((tuple(r) for r in merge_upsert(target, source, ["k"], delete_when="d", colocated=colocated).collect()), key=repr)
    assert got == model_merge(t_rows, s_rows)


history_rows = st.lists(st.tuples(keys, st.integers(0, 9), st.booleans()), max_size=12, unique_by=lambda r: (r[0], r[1]))


@SETTINGS
@given(history_rows, st.integers(0, 9))
def test_snapshot_matches_model(spark, rows, as_of):
    df = spark.createDataFrame(rows, "k INT, ver INT, gone BOOLEAN")
    got = sorted((tuple(r) for r in snapshot_as_of(df, ["k"], ["ver"], as_of, deleted="gone").collect()), key=repr)
    latest, singles = {}, []
    for k, ver, gone in rows:
        if ver > as_of:
            continue
        if k is None:
            singles.append((k, ver, gone))
        elif k not in latest or ver > latest[k][1]:
            latest[k] = (k, ver, gone)
    expected = sorted([r for r in [*latest.values(), *singles] if not r[2]], key=repr)
    assert got == expected


side_rows = st.lists(st.tuples(keys, st.one_of(st.none(), st.sampled_from("pq"))), max_size=8)


@SETTINGS
@given(side_rows, side_rows)
def test_reconcile_matches_model(spark, e_rows, a_rows):
    e_rows, a_rows = unique_complete_keys(e_rows), unique_complete_keys(a_rows)
    e = spark.createDataFrame(e_rows, "k INT, v STRING")
    a = spark.createDataFrame(a_rows, "k INT, v STRING")
    got = sorted((tuple(r) for r in reconcile(e, a, ["k"]).collect()), key=repr)
    e_map = {k: v for k, v in e_rows if k is not None}
    a_map = {k: v for k, v in a_rows if k is not None}
    expected = [(k, "missing", None) for k, v in e_rows if k is None or k not in a_map]
    expected += [(k, "extra", None) for k, v in a_rows if k is None or k not in e_map]
    expected += [(k, "changed", "v") for k in e_map.keys() & a_map.keys() if e_map[k] != a_map[k]]
    assert got == sorted(expected, key=repr)


batch_rows = st.lists(
    st.tuples(keys, st.integers(0, 3), st.integers(0, 9)), max_size=12, unique_by=lambda r: (r[0], r[1], r[2])
)


@SETTINGS
@given(batch_rows)
def test_fold_matches_model(spark, rows):
    from stevedore.operators import fold_batches

    df = spark.createDataFrame(rows, "k INT, batch INT, seq INT")
    got = sorted((tuple(r) for r in fold_batches(df, ["k"], "batch", ["seq"]).collect()), key=repr)
    groups: dict = {}
    singles = []
    for k, b, q in rows:
        if k is None:
            singles.append((k, b, q, 1))
        else:
            groups.setdefault(k, []).append((b, q))
    expected = [(k, *max(v), len({b for b, _ in v})) for k, v in groups.items()] + singles
    assert got == sorted(expected, key=repr)


@SETTINGS
@given(history_rows, st.integers(0, 9), st.integers(0, 9))
def test_retention_keeps_answers_from_the_cutoff(spark, rows, hours, as_of_offset):
    import datetime as dt

    from stevedore.operators import retain_history

    base = dt.datetime(2024, 1, 1)
    timed = [(k, base + dt.timedelta(hours=v), g) for k, v, g in rows]
    df = spark.createDataFrame(timed, "k INT, ts TIMESTAMP_NTZ, gone BOOLEAN")
    now = base + dt.timedelta(hours=9)
    trimmed = retain_history(df, ["k"], ["ts"], hours=hours, now=now)
    as_of = now - dt.timedelta(hours=hours) + dt.timedelta(hours=as_of_offset)

    def snap(frame):
        return sorted((tuple(r) for r in snapshot_as_of(frame, ["k"], ["ts"], as_of, deleted="gone").collect()), key=repr)

    assert snap(trimmed) == snap(df)


text = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\n\r") | st.sampled_from("\t[]-:\x01\x02\x03"), max_size=30)
log_entries = st.lists(
    st.tuples(
        st.datetimes(min_value=__import__("datetime").datetime(2000, 1, 1), max_value=__import__("datetime").datetime(2030, 1, 1)),
        st.sampled_from(["DEBUG", "INFO", "WARN", "ERROR", "UNKNOWN"]),
        st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="]"), min_size=1, max_size=12),
        st.from_regex(r"[A-Za-z][A-Za-z0-9_.$]{0,15}", fullmatch=True),
        st.integers(1, 99999),
        text,
        st.integers(0, 2),
    ),
    min_size=1,
    max_size=15,
)


@SETTINGS
@given(log_entries)
def test_parse_round_trips_every_layout(spark, entries):
    import datetime as dt

    from pyspark.sql import functions as F

    from stevedore.functions import format_bracket, format_log4j_line, format_log4j_thread
    from stevedore.sources import parse_logs

    rows = [(i, ts, lvl, th, lg, ln, msg, lay) for i, (ts, lvl, th, lg, ln, msg, lay) in enumerate(entries)]
    df = spark.createDataFrame(
        rows, "i INT, ts TIMESTAMP_NTZ, level STRING, thread STRING, logger STRING, line_no INT, message STRING, lay INT"
    )
    c = F.col
    line = (
        F.when(c("lay") == 0, format_bracket(c("ts"), c("level"), c("message")))
        .when(c("lay") == 1, format_log4j_thread(c("ts"), c("level"), c("thread"), c("logger"), c("message")))
        .otherwise(format_log4j_line(c("ts"), c("level"), c("logger"), c("line_no"), c("message")))
    )
    parsed = parse_logs(df.select(c("i").cast("string").alias("source"), line.alias("value")))
    got = {int(r.source): r for r in parsed.collect()}
    for i, ts, lvl, th, lg, ln, msg, lay in rows:
        r = got[i]
        if lay == 0:
            want_ts = ts.replace(microsecond=0)
        else:
            want_ts = ts.replace(microsecond=ts.microsecond // 1000 * 1000)
        assert r.ts == want_ts and r.level == lvl and r.message == msg, (r, entries[i])
        assert r.thread == (th if lay == 1 else None)
        assert r.logger == (lg if lay != 0 else None)
        assert r.line_no == (ln if lay == 2 else None)


setting_pairs = st.lists(
    st.tuples(
        st.from_regex(r"[A-Za-z_][A-Za-z0-9_.]{0,20}", fullmatch=True),
        st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc", "Zl", "Zp")) | st.sampled_from("= #"), max_size=25),
    ),
    min_size=1,
    max_size=10,
    unique_by=lambda p: p[0],
)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(setting_pairs, st.sampled_from(["kv", "conf"]))
def test_settings_round_trip(spark, pairs, kind):
    import os
    import re
    import uuid

    from stevedore.functions.secrets import HIDDEN, SECRET_NAME_PATTERN
    from stevedore.session import scratch_path
    from stevedore.sources import extract_settings

    pairs = [(k, v) for k, v in pairs if not (len(v.strip(" ")) >= 2 and v.strip(" ")[0] in "\"'" and v.strip(" ")[-1] == v.strip(" ")[0])]
    root = scratch_path(spark, "settings-prop").removeprefix("file:")
    os.makedirs(root)
    sep = "=" if kind == "kv" else " "
    with open(os.path.join(root, f"{uuid.uuid4().hex}.txt"), "w", encoding="utf-8") as f:
        f.write("# header\n\n" + "".join(f"{k}{sep}{v}\n" for k, v in pairs))
    got = {r.name: r.value for r in extract_settings(spark, root, kind).collect()}

    def expected_value(k, v):
        # Spark's trim removes ASCII spaces only; Java's \s is ASCII white space.
        if kind == "kv":
            v = v.strip(" ")
        else:
            parts = re.split(r"[ \t\n\x0b\f\r]+", f"{k} {v}".strip(" "), maxsplit=1)
            v = parts[1].strip(" ") if len(parts) == 2 else None
        if v is not None and re.search(SECRET_NAME_PATTERN.removeprefix("(?i)"), k, re.I):
            return HIDDEN
        return v

    assert got == {k: expected_value(k, v) for k, v in pairs}


error_lines = st.lists(
    st.tuples(
        st.sampled_from(["s1", "s2", "s3"]),
        st.one_of(st.none(), st.integers(0, 5)),
        st.sampled_from(["ok", "Error here", "an EXCEPTION", "job failed", "fine", "errors"]),
        st.integers(0, 999),
    ),
    max_size=25,
    unique_by=lambda r: (r[0], r[3]),
)


@SETTINGS
@given(error_lines, st.integers(1, 4))
def test_error_tail_and_verdict_match_model(spark, rows, n):
    import re

    from stevedore.operators import error_tail, error_verdict
    from stevedore.sources import parse_logs

    def line(minute, text, i):
        if minute is None:
            return f"  at {text} #{i}"
        return f"[2024-03-01 10:0{minute}:00] [INFO] {text} #{i}"

    raws = [(src, line(m, t, i)) for src, m, t, i in rows]
    logs = parse_logs(spark.createDataFrame(raws, "source STRING, value STRING"))
    hit = re.compile("error|exception|failed", re.I)

    got = sorted((r.source, r.raw, r.recency) for r in error_tail(logs, n).collect())
    expected = []
    for src in {s for s, _ in raws}:
        mine = [(m, raw) for (s, raw), (_, m, _, _) in zip(raws, rows) if s == src and hit.search(raw)]
        # newest first, untimed last, ties by text descending (two stable sorts)
        mine.sort(key=lambda x: x[1], reverse=True)
        mine.sort(key=lambda x: (x[0] is None, -(x[0] or 0)))
        expected += [(src, raw, i + 1) for i, (_, raw) in enumerate(mine[:n])]
    assert got == sorted(expected)

    verdict = {r.source: (r.n_lines, r.n_errors, r.has_errors) for r in error_verdict(logs).collect()}
    model = {}
    for s, raw in raws:
        lines_, errs = model.get(s, (0, 0))
        model[s] = (lines_ + 1, errs + (1 if hit.search(raw) else 0))
    assert verdict == {s: (a, b, b > 0) for s, (a, b) in model.items()}


POOL = {"a": ["int", "bigint"], "b": ["float", "double"], "c": ["string"]}
frame_spec = st.tuples(
    st.lists(st.sampled_from(sorted(POOL)), min_size=1, max_size=3, unique=True),
    st.data(),
)


@SETTINGS
@given(frame_spec, frame_spec)
def test_evolve_append_matches_model(spark, base_spec, inc_spec):
    from stevedore.operators import evolve_append

    def build(spec, offset):
        cols, data = spec
        types = [data.draw(st.sampled_from(POOL[c])) for c in cols]
        values = {"a": offset + 1, "b": offset + 0.5, "c": f"s{offset}"}
        row = tuple(values[c] for c in cols)
        ddl = ", ".join(f"{c} {t}" for c, t in zip(cols, types))
        return spark.createDataFrame([row], ddl), dict(zip(cols, types)), dict(zip(cols, row))

    base, base_types, base_row = build(base_spec, 0)
    inc, inc_types, inc_row = build(inc_spec, 10)
    out = evolve_append(base, inc)
    order = list(base_types) + [c for c in inc_types if c not in base_types]
    assert out.columns == order
    rank = ["int", "bigint", "float", "double"]
    for c in order:
        t = [x for x in (base_types.get(c), inc_types.get(c)) if x]
        want = max(t, key=rank.index) if t[0] in rank else t[0]
        if len(t) == 2 and "float" in t and t[0] != t[1] and max(t, key=rank.index) == "float":
            want = "double"
        assert out.schema[c].dataType.simpleString() == want, (c, t)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    expected = sorted([tuple(base_row.get(c) for c in order), tuple(inc_row.get(c) for c in order)], key=repr)
    assert got == expected
