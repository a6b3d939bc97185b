"""Secrets in text, by DataFrame functions alone: multipart credential linking.

One pass over the texts finds parts: strong ones, which count by themselves (an assignment of a secret,
an access identifier, a long hex run), and weak ones, which may be anything (short access
identifiers, identifier assignments, assignments of other secret-like names, bare tokens that look like keys,
service endpoints). The parts
go to a table, and so do the places where a scope ends: a blank line, a section header, a rule. An interval
join gives each part its scope, and a weak candidate is reported only where a complementary part lies in
the same one, however far off. The texts themselves are never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stevedore.llm.common import staged

KINDS = ("assign", "access", "hex")
#: Joins by place are on stretches of so many characters. It changes the work, not the results.
STRETCH = 4096

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: what each could be a part of a credential with.
WEAK_ACCESS = r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}\b"
WEAK_IDENTIFIER = r"""\b(?i:client_?id|access_?key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,39}[0-9])(?=[A-Z0-9+/_-]{0,39}[a-z])(?=[a-z0-9+/_-]{0,39}[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Assignments of other names for secrets, and tokens of one case with digits; not of access identifiers.
_NO_ACCESS = r"(?!(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9])"
WEAK_ASSIGN = (
    r"(?<![A-Za-z0-9])(?i:(?:secret|private|access|auth|api|account|client|signing|encryption|master|shared)(?:[_.-]?(?:secret|access|shared|signing))?[_.-]?key"
    r"|(?:secret|token|password|passwd)[_.-][a-z0-9_.-]{1,24}|pwd|pass(?:phrase)?|auth(?:orization)?|credentials?)"
    rf"""["']?\x20*[:=]\x20*["']?{_NO_ACCESS}[A-Za-z0-9+/_.=-]{{8,}}"""
)
WEAK_TOKEN = rf"(?<![A-Za-z0-9+/_=-]){_NO_ACCESS}(?:(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{{20,}}|(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{{20,}})(?![A-Za-z0-9+/_-])={{0,6}}"
WEAK_ENDPOINT = r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9._:@-]+"

#: The line end at which a scope ends, always one character: before a blank line, a section header (``[name]``) or a rule (``---``) on a line of its own.
BREAK = r"\n(?=[\x20\t\r]*\n|[\x20\t]*\[{1,2}[A-Za-z][^\[\]\n,]*\]{1,2}[\x20\t\r]*(?:\n|\z)|(?:-{3,}|={3,})[\x20\t\r]*(?:\n|\z))"
#: Every text with a part matches this, and few others do: the patterns run on texts that pass only.
GATE = (
    r"""[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3}|://|A(?:KIA|SIA|ROA|IDA)[A-Z0-9]|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"""
)

#: kind, pattern, role. Two parts are complementary if their roles differ.
PARTS = (
    ("assign", ASSIGN, "secret"),
    ("access", ACCESS, "identifier"),
    ("hex", HEX, "secret"),
    ("weak_access", WEAK_ACCESS, "identifier"),
    ("weak_identifier", WEAK_IDENTIFIER, "identifier"),
    ("weak_secret", WEAK_SECRET, "secret"),
    ("weak_assign", WEAK_ASSIGN, "secret"),
    ("weak_token", WEAK_TOKEN, "secret"),
    ("weak_endpoint", WEAK_ENDPOINT, "endpoint"),
)
#: How a linked weak part is reported; an endpoint is evidence, never reported itself.
REPORTED = {"weak_access": "access", "weak_identifier": "access", "weak_secret": "assign", "weak_assign": "assign", "weak_token": "assign"}
#: These don't confirm what they overlap, and give way to reported parts of a lower number that they overlap.
LATE = {"weak_assign": 2, "weak_token": 3}


ROLE = {kind: role for kind, _, role in PARTS}


def parts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A staged table with one row for each row of ``docs``: row (a number), doc_id, and for each kind of
    part an array of (gap, size, ok): code points since the last match, in the match, and whether it counts.
    """
    held = F.col("text").rlike(GATE)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = rows.select("row", "doc_id", "text", *(F.when(held, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p, _ in PARTS))

    def sized(kind: str, pattern: str) -> Column:
        matches = F.col(f"m_{kind}")
        zipped = F.arrays_zip(
            F.slice(F.split("text", pattern, -1), 1, F.size(matches)).alias("gap"),
            matches.alias("match"),
            (F.regexp_extract_all("text", F.lit(pattern), F.lit(1)) if kind == "assign" else matches).alias("value"),
        )
        rows = F.transform(zipped, lambda m: F.struct(
            F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("size"), (F.length(m["value"]) >= (12 if kind == "assign" else 0)).alias("ok")
        ))
        return F.when(F.size(matches) > 0, rows).alias(kind)

    # Scopes are needed only where there is something weak to report.
    weak = reduce(or_, (F.coalesce(F.size(f"m_{k}") > 0, F.lit(False)) for k in REPORTED))
    scopes = F.when(weak, F.transform(F.split("text", BREAK, -1), F.length)).alias("scopes")
    return staged(found.select("row", "doc_id", *(sized(k, p) for k, p, _ in PARTS), scopes), "secret-parts")


def located(table: DataFrame) -> DataFrame:
    """One row for each part that counts: row, kind, role, start, end (code points)."""

    def named(kind: str) -> Column:
        rows = F.transform(kind, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m["gap"].alias("gap"), m["size"].alias("size"), m["ok"].alias("ok")))
        return F.coalesce(rows, F.expr("cast(array() as array<struct<kind:string,nth:int,gap:int,size:int,ok:boolean>>)"))

    every = F.concat(*(named(k) for k, _, _ in PARTS))
    each = table.select("row", F.inline(every))
    # Places are running sums over the matches of one kind in one row.
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(before)
    role = F.create_map(*(F.lit(x) for kind in ROLE.items() for x in kind))[F.col("kind")]
    return each.withColumn("end", end).filter("ok").select("row", "kind", role.alias("role"), (F.col("end") - F.col("size")).alias("start"), "end")


def scoped(places: DataFrame, table: DataFrame) -> DataFrame:
    """``places`` with ``scope``, where the part's scope begins; rows of ``table`` without scopes go.

    Scopes and parts are intervals joined on (row, stretch of characters), so that a long text is spread over many
    keys; a part begins in one scope and one stretch."""
    ends = table.select("row", F.posexplode("scopes").alias("nth", "size"))
    upto = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Each piece is followed by its break, one character.
    scopes = ends.withColumn("high", F.sum(F.col("size") + 1).over(upto)).withColumn("scope", F.col("high") - F.col("size") - 1)
    scopes = scopes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("scope") / STRETCH), F.floor((F.col("high") - 1) / STRETCH)))).alias("s")
    parts_at = places.withColumn("bin", F.floor(F.col("start") / STRETCH)).alias("p")
    inside = (F.col("p.row") == F.col("s.row")) & (F.col("p.bin") == F.col("s.bin")) & (F.col("p.start") >= F.col("s.scope")) & (F.col("p.start") < F.col("s.high"))
    return parts_at.join(scopes, inside).select("p.row", "s.scope", "kind", "role", "start", "end")


def linked(places: DataFrame, table: DataFrame) -> DataFrame:
    """Weak parts with a part of another role in their scope, that don't
    overlap a strong part (nor, if LATE, one that comes before them). What a scope holds of a role is one row when
    it meets the candidates: whether a part not LATE, the first end and the last start. So a scope of many parts makes no pairs."""
    stretch = lambda low, high: F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH)))
    strong = F.col("kind").isin(*KINDS)
    within = scoped(places, table)
    late = F.col("kind").isin(*LATE)
    evidence = within.groupBy("row", "scope", "role").agg(
        F.max(~late).alias("firm"), F.min("end").alias("first_end"), F.max("start").alias("last_start")
    ).alias("o")
    weak = within.filter(F.col("kind").isin(*REPORTED)).alias("w")
    meets = (
        (F.col("w.row") == F.col("o.row")) & (F.col("w.scope") == F.col("o.scope")) & (F.col("w.role") != F.col("o.role"))
        & (~F.col("w.kind").isin(*LATE) & F.col("o.firm") | (F.col("o.last_start") >= F.col("w.end")) | (F.col("o.first_end") <= F.col("w.start")))
    )
    near = weak.join(evidence, meets, "left_semi").select("row", "kind", "start", "end").distinct()
    narrow = near.withColumn("bin", stretch(F.col("start"), F.col("end"))).alias("w")
    order = lambda kind: F.when(kind.isin(*KINDS), 0).when(kind == "weak_assign", LATE["weak_assign"]).when(kind == "weak_token", LATE["weak_token"]).otherwise(1)
    certain = places.filter(strong).select("row", "kind", "start", "end").unionByName(near.filter(F.col("kind") != "weak_token")).withColumn("bin", stretch(F.col("start"), F.col("end"))).alias("o")
    covers = (F.col("w.row") == F.col("o.row")) & (F.col("w.bin") == F.col("o.bin")) & (F.col("o.start") < F.col("w.end")) & (F.col("o.end") > F.col("w.start")) & (order(F.col("o.kind")) < order(F.col("w.kind")))
    covered = narrow.join(certain, covers, "left_semi").select("row", "kind", "start", "end").distinct()
    return near.join(covered, ["row", "kind", "start", "end"], "left_anti")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id and ``spans``, an array of (start, rank of kind, kind, end,
    base), sorted. ``base`` is false for weak parts reported because they were linked.

    Null and empty texts have no spans. Repeated rows each get theirs; null ids are kept. Other columns
    are ignored. An empty table gives none.
    """
    table = parts(docs, doc_id=doc_id, text=text)
    places = staged(located(table), "secret-places")
    reported = F.create_map(*(F.lit(x) for kind in REPORTED.items() for x in kind))
    strong = places.filter(F.col("kind").isin(*KINDS)).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    weak = linked(places, table).select("row", reported[F.col("kind")].alias("kind"), "start", "end", F.lit(False).alias("base")).distinct()
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = strong.unionByName(weak).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "base"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:bigint,kind:string,end:bigint,base:boolean>>)")
    return table.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return find(docs, doc_id=doc_id, text=text).select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
