"""Personal data: base patterns give seeds, and what surrounds the seeds finds identifiers that the patterns miss.

Every text is read once. Base matches and other tokens that look like identifiers are instances; the words around an
instance are its patterns. Spark scores the graph between both: a pattern is as good for a kind as the share of its
distinct instances that are of this kind, among those whose kind is known or whose shape is another; those that have the
kind's shape and may be what is sought weigh ``OPEN`` each. An instance without base match is as good as its good
patterns together; rounds are run until no new instance appears, as new ones support further patterns. Instances of high confidence and of the kind's shape are added.

The graph is joined by its own keys and never collected; instances and patterns are counted once however often they
occur, so one identifier in a third of all rows does no harm.

Defined cases: null text is empty; an empty text has no spans; failing base matches are dropped without retry; an added
span never overlaps a base span; texts, words and instances of any length are read whole, and long words and instances stand in the
graph by a digest; of ties in score the kind last by name counts; repeated rows are read each; an empty table gives no rows; other columns pass through
``found`` when asked for, and are ignored otherwise.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
MAYBE = re.compile(r"[0-9@]|[\[({]at[\])}]", re.I)
#: Digit groups, and tokens; those with a digit or an at sign may be identifiers.
LOOSE = re.compile(r"[(+]?[0-9](?:[\x20().\-/]{0,3}[0-9])+|[^\s,;<>\"']++")
#: What an instance of the kind's shape and of unknown kind counts against a pattern.
OPEN = 0.1
#: Names that no table has, for what reading adds.
ROW = "_pii_row long, _pii_n array<long>, _pii_base string, _pii_seen array<struct<first:int,last:int,instance:string,kind:string,fits:array<string>,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match's local part is all that stands before an at sign; so each at sign is tried once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def fits(instance: str) -> list[str]:
    """The kinds whose shape a loose token has."""
    n, mail = len(digits_of(instance)), "@" in instance or re.search(r"[\[({]at[\])}]", instance, re.I)
    out = ["email"] if mail and re.search(r"\w.*(?:@|at).*\w", instance) else []
    if not mail and not re.search(r"[A-Za-z]", instance):
        groups = re.findall(r"[0-9]+", instance)
        out += ["ip"] * (len(groups) == 4 and all(len(g) <= 3 for g in groups)) + ["card"] * (12 <= n <= 19) + ["phone"] * (7 <= n <= 15)
    return out


def short(x: str) -> str:
    """A text of any length by a bounded one that stands for it alone."""
    return x if len(x) <= 64 else f"#{hashlib.sha256(x.encode('utf-8', 'replace')).hexdigest()}"


class Context:
    """The words of a text, and those around a place."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = zip(*(m.span() for m in WORD.finditer(text))) if not text.isspace() and text else ((), ())

    def word(self, a: int, z: int) -> str:
        return short(self.text[a:z].lower())

    def patterns(self, start: int, end: int) -> list[str]:
        """The words on both sides, one and two on the left, one on the right, and one on either; a word may be cut by the instance."""
        i = bisect.bisect_left(self.starts, start)  # words that begin before the instance
        left = [self.word(self.starts[k], min(self.ends[k], start)) for k in range(max(0, i - 2), i)]
        j = bisect.bisect_right(self.ends, end)  # words that end behind it
        right = [self.word(max(self.starts[j], end), self.ends[j])] if j < len(self.ends) else []
        out = [f"l {left[-1]}"] if left else []
        if len(left) == 2:
            out.append(f"ll {left[0]} {left[1]}")
        if right:
            out.append(f"r {right[0]}")
            if left:
                out.append(f"lr {left[-1]} {right[0]}")
        return out


def read(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of ROW at the end: a number for the row, base counts and spans, and all instances with their patterns."""
    added = docs.sparkSession.createDataFrame([], ROW).schema
    names, at = [*docs.columns, *added.names], docs.columns.index(text)
    seen_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("instance", pa.string()), ("kind", pa.string()), ("fits", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ns, bases, all_seen = [], [], []
            for t in b.column(at):
                n, base, seen = instances(t.as_py() or "")
                ns.append(n)
                bases.append(base)
                all_seen.append(seen)
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, rows, pa.array(ns, pa.list_(pa.int64())), pa.array(bases, pa.string()), pa.array(all_seen, seen_type)], names)

    return docs.mapInArrow(run, StructType([*docs.schema, *added]))


def instances(t: str) -> tuple[list[int], str, list[dict]]:
    """Base counts, base spans, and all instances of a text."""
    n, base, seen = [0] * len(KINDS), [], []
    if MAYBE.search(t):
        base, around = base_spans(t), Context(t)
        for kind, a, z in base:
            n[KINDS.index(kind)] += 1
            seen.append({"first": a, "last": z, "instance": short(t[a:z]), "kind": kind, "fits": [], "patterns": around.patterns(a, z)})
        taken, k = sorted((a, z) for _, a, z in base), 0
        for m in filter(lambda m: MAYBE.search(m[0]), LOOSE.finditer(t)):
            a = m.start()
            z = a + len(m[0].rstrip(".:!?)]}|-"))
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if a < z and not any(x < z and a < y for x, y in taken[k : k + 8]):
                seen.append({"first": a, "last": z, "instance": short(t[a:z]), "kind": None, "fits": fits(t[a:z]), "patterns": around.patterns(a, z)})
    return n, ",".join(f"{k}:{a}:{z}" for k, a, z in base), seen


def discovered(rows: DataFrame, least_support: int = 8, least_share: float = 0.9) -> DataFrame | None:
    """(instance, kind) of instances that the graph finds and no base pattern does; None where no pattern is good enough."""
    each = rows.select(F.explode("_pii_seen").alias("s")).select("s.instance", "s.kind", "s.fits", "s.patterns")
    links = stored(each.select("instance", F.explode("patterns").alias("pattern")).distinct(), "links")
    of_kind = each.filter("kind is not null").select("instance", "kind").distinct()
    shapes = each.filter("kind is null").select("instance", F.explode("fits").alias("kind")).distinct()
    believed = stored(of_kind.withColumn("score", F.lit(1.0)), "believed")
    shapes = stored(shapes.join(of_kind.select("instance").distinct(), "instance", "left_anti"), "shapes")
    if shapes.isEmpty():
        return None
    sizes = stored(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least_support), "sizes")
    new, before, open_ = None, 0, shapes
    while True:
        hits = links.join(believed, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("hits"))
        unknown = links.join(open_, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("unknown"))
        of = hits.filter(F.col("hits") >= least_support).join(sizes, "pattern").join(unknown, ["pattern", "kind"], "left")
        good = of.withColumn("share", F.col("hits") / (F.col("size") - (1 - OPEN) * F.coalesce("unknown", F.lit(0)))).filter(F.col("share") >= least_share)
        good = stored(good.select("pattern", "kind", "share"), "good")
        if good.isEmpty():
            return None
        doubt = F.exp(F.sum(F.log1p(-F.least("share", F.lit(0.99)))))
        found = links.join(good, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score")).filter(F.col("score") >= least_share).join(shapes, ["instance", "kind"], "left_semi")
        new = stored(found, "new")
        if (now := new.count()) <= before:
            break
        before = now
        believed = of_kind.withColumn("score", F.lit(1.0)).union(new.select("instance", "kind", "score"))
        open_ = shapes.join(new, ["instance", "kind"], "left_anti")
    return new.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def found(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, and _pii_n (base counts by KINDS), _pii_base (base spans as text), _pii_added (kind:start:end each)."""
    nothing = F.array().cast("array<string>")
    read_rows = read(docs.select(*dict.fromkeys([*keep, text])), text)
    rows = stored(read_rows.select(*keep, "_pii_row", "_pii_n", "_pii_base", "_pii_seen"), "read")
    new = discovered(rows)
    if new is None:
        return rows.select(*keep, "_pii_n", "_pii_base", nothing.alias("_pii_added"))
    loose = rows.select("_pii_row", F.explode(F.filter("_pii_seen", lambda s: s["kind"].isNull())).alias("s")).select("_pii_row", "s.instance", "s.first", "s.last")
    added = loose.join(new, "instance").groupBy("_pii_row").agg(F.collect_list(F.concat_ws(":", "kind", "first", "last")).alias("_pii_added"))
    return rows.drop("_pii_seen").join(added, "_pii_row", "left").select(*keep, "_pii_n", "_pii_base", F.coalesce("_pii_added", nothing).alias("_pii_added"))


def in_order(base: str, added: list[str]) -> str:
    spans = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in [*filter(None, base.split(",")), *added])]
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by ``[kind]``; the outermost of overlapping spans counts."""
    names, at = docs.columns, docs.columns.index(text)
    columns = [f"c{i}" for i in range(len(names))]  # no column of docs has a name of ROW
    rows = found(docs.toDF(*columns), columns, columns[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, base, added in zip(b.column(at), b.column(len(columns)), b.column(len(columns) + 1), strict=True):
                t, base, added = t.as_py(), base.as_py(), added.as_py()
                if base or added:
                    pieces, end = [], 0
                    for kind, a, z in sorted(((k, int(a), int(z)) for k, a, z in (x.split(":") for x in [*filter(None, base.split(",")), *added])), key=lambda s: (s[1], -s[2])):
                        if a >= end:
                            pieces += [t[end:a], f"[{kind}]"]
                        end = max(end, z)
                    t = "".join([*pieces, t[end:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : len(columns)]], columns)

    return rows.select(*columns, "_pii_base", "_pii_added").mapInArrow(run, docs.toDF(*columns).schema).toDF(*names)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, added = b.column(2).to_pylist(), b.column(3).to_pylist()
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            n = list(zip(*b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha), pa.array([in_order(x, y) for x, y in zip(base, added, strict=True)])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.select("doc_id", "_pii_n", "_pii_base", "_pii_added").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
