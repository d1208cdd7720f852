"""Budgeted, diversity-capped selection.

Gates, pool, target, floors, caps and spacing are set-based. The admission itself is sequential by definition: every
choice changes the counters of the next. It runs over one group of narrow, gated rows; ``relaxed`` variants with
windows (one cap at a time) scale without it.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.scalars import est_size

# The shares of the buckets, and what counts as a match of a subject.
BUCKETS = {"people": 0.50, "location": 0.20, "bike": 0.10, "landscape": 0.05, "aesthetic": 0.15}
SUBJECT_MATCH = 0.20
NARROW = ["path", "score", "timestamp", "cluster_id", "person_id", "is_frequent", "est", "day", "hour"]


@dataclass(frozen=True)
class Rules:
    max_bytes: int = 1 << 30
    per_cluster: float = 0.20
    per_person: float = 0.10
    per_location: float = 0.30
    per_day: float = 0.15
    per_hour: float = 0.05
    min_score_pct: float = 0.0
    min_pool_fraction: float = 0.40
    buckets: dict = field(default_factory=lambda: dict(BUCKETS))
    percentage: float | None = None
    total: int = 0
    resize: bool = True
    max_spacing: float = 600.0
    min_gap: float = 60.0
    min_blur: float = 50.0
    long_side: int = 2560
    quality: int = 92

    def shares(self) -> dict[str, float]:
        if any(v < 0 for v in self.buckets.values()) or sum(self.buckets.values()) <= 0:
            raise ValueError(f"bucket shares must not be negative and their sum must be positive: {self.buckets}")
        total = sum(self.buckets.values())
        return {k: v / total for k, v in self.buckets.items()} if abs(total - 1) > 1e-6 else dict(self.buckets)


def pool(items: DataFrame, rules: Rules) -> DataFrame:
    """Eligible items: all that pass quality, and the best others up to a floor."""
    fine = F.lit(True) if rules.min_blur <= 0 else F.coalesce("blur_score", F.lit(0.0)) >= rules.min_blur
    eligible = items.filter((F.coalesce("is_duplicate", F.lit(0)) == 0) & (F.coalesce("is_private", F.lit(0)) == 0) & fine)
    passed = F.coalesce("quality_pass", F.lit(1)) != 0
    n, strict = eligible.agg(F.count("*"), F.count_if(passed)).first()
    need = int(n * rules.min_pool_fraction) - strict
    kept = eligible.filter(passed)
    return kept.unionByName(eligible.filter(~passed).orderBy(F.desc("score"), "path").limit(need)) if rules.min_pool_fraction > 0 and need > 0 else kept


def spacing(items: DataFrame, selectivity: float, cluster_cap: int, most: float) -> DataFrame:
    """cluster_id, spacing: seconds between chosen items of a cluster."""
    s = items.filter("cluster_id >= 0 and timestamp > 0").groupBy("cluster_id").agg(F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("d"))
    target = F.least(F.col("n") * F.lit(selectivity), F.greatest(F.lit(0.5), F.col("d") / 120.0), F.lit(float(cluster_cap)))
    wide = F.when(target <= 1, F.lit(float("inf"))).otherwise(F.col("d") / target * 0.6)
    return s.select("cluster_id", F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(60.0), wide))).alias("spacing"))


def day_key():
    t = F.timestamp_seconds("timestamp")
    return F.when(F.coalesce("timestamp", F.lit(0.0)) <= 0, F.concat(F.lit("none "), "path")).otherwise(F.date_format(t, "yyyyDDD"))


def hour_key():
    t = F.timestamp_seconds("timestamp")
    return F.when(F.coalesce("timestamp", F.lit(0.0)) <= 0, F.concat(F.lit("none "), "path")).otherwise(F.date_format(t, "yyyyDDDHH"))


class Admission:
    """The sole judge of additions, with the counters that all fillers share."""

    def __init__(self, rules: Rules, most: int | None, caps: dict, gaps: dict):
        self.rules, self.most, self.caps, self.gaps = rules, most, caps, gaps
        self.chosen: list[dict] = []
        self.paths: set[str] = set()
        self.times: list[float] = []
        self.cluster_times: dict[int, list[float]] = defaultdict(list)
        self.days, self.hours, self.people, self.places, self.clusters = (defaultdict(int) for _ in range(5))
        self.bytes = 0

    def done(self) -> bool:
        return self.most is not None and len(self.chosen) >= self.most or self.bytes >= self.rules.max_bytes

    @staticmethod
    def _near(times: list[float], t: float, gap: float) -> bool:
        i = bisect.bisect_left(times, t)
        return i < len(times) and times[i] - t < gap or i > 0 and t - times[i - 1] < gap

    def full_cluster(self, c: int) -> bool:
        return self.caps["cluster"] is not None and c >= 0 and self.clusters[c] >= self.caps["cluster"]

    def full_person(self, p: int) -> bool:
        return p >= 0 and self.people[p] >= self.caps["person"]

    def full_time(self, r: dict) -> bool:
        return any(self.caps[k] is not None and counts[r[k]] >= self.caps[k] for k, counts in (("day", self.days), ("hour", self.hours)))

    def add(self, r: dict) -> bool:
        t, c = r["timestamp"] or 0, r["cluster_id"]
        if r["path"] in self.paths:
            return False
        if t > 0 and c >= 0 and (gap := self.gaps.get(c, 0)) > 0 and self._near(self.cluster_times[c], t, gap):
            return False
        if t > 0 and self.rules.min_gap > 0 and self._near(self.times, t, self.rules.min_gap):
            return False
        if self.bytes + r["est"] > self.rules.max_bytes or self.most is not None and len(self.chosen) >= self.most or self.full_time(r):
            return False
        self.paths.add(r["path"])
        self.chosen.append(r)
        self.bytes += r["est"]
        if t > 0:
            bisect.insort(self.times, t)
            if c >= 0:
                bisect.insort(self.cluster_times[c], t)
        self.days[r["day"]] += 1
        self.hours[r["hour"]] += 1
        return True

    def book(self, r: dict) -> None:
        self.clusters[r["cluster_id"]] += 1
        if r["person_id"] >= 0:
            self.people[r["person_id"]] += 1

    def fill(self, rows: list[dict], budget: int, cap: int | None, fits, booked=None) -> None:
        """One bucket: rows in order, while its own budget and count last."""
        used = n = 0
        for r in rows:
            if self.done() or cap is not None and n >= cap:
                return
            if r["path"] in self.paths or not fits(r) or self.full_cluster(r["cluster_id"]) or self.full_person(r["person_id"]) or used + r["est"] > budget:
                continue
            if self.add(r):
                self.book(r)
                if booked:
                    booked(r)
                used += r["est"]
                n += 1

    def spread(self, rows: list[dict], budget: int, cap: int | None) -> None:
        """The best admissible item of each day not yet present, then of each cluster."""
        used = n = 0
        for key, counts, real in (("day", self.days, lambda r: True), ("cluster_id", self.clusters, lambda r: r["cluster_id"] >= 0)):
            present = {k for k, v in counts.items() if v > 0}
            if key == "day" and self.caps["day"] is None:
                present = set()  # days are only counted under a cap
            queues: dict = {}
            for r in rows:
                if r["path"] not in self.paths and real(r) and r[key] not in present:
                    queues.setdefault(r[key], []).append(r)
            for queue in queues.values():
                if self.done() or cap is not None and n >= cap:
                    break
                for r in queue:
                    if r["path"] in self.paths or self.full_person(r["person_id"]) or self.full_cluster(r["cluster_id"]):
                        continue
                    if used + r["est"] > budget:
                        break
                    if self.add(r):
                        self.book(r)
                        used += r["est"]
                        n += 1
                        break

    def round_robin(self, rows: list[dict]) -> None:
        """Days in turn, those with the fewest chosen first, then those with the longest queue."""
        queues: dict = {}
        for r in rows:
            if r["path"] not in self.paths:
                queues.setdefault(r["day"], []).append(r)
        count = (lambda d: self.days[d]) if self.caps["day"] is not None else (lambda d: 0)
        progress = True
        while progress and len(self.chosen) < self.most:
            progress = False
            for day in sorted((d for d, q in queues.items() if q), key=lambda d: (count(d), -len(queues[d]))):
                if len(self.chosen) >= self.most:
                    return
                if self.caps["day"] is not None and self.days[day] >= self.caps["day"]:
                    queues[day] = []
                    continue
                while queues[day]:
                    r = queues[day].pop(0)
                    if not self.full_person(r["person_id"]) and not self.full_cluster(r["cluster_id"]) and self.add(r):
                        self.book(r)
                        progress = True
                        break


def admit(rows: list[dict], rules: Rules, most: int | None, caps: dict, gaps: dict) -> list[dict]:
    """rows: by score, best first; each may have a map ``subjects`` of similarities."""
    a, shares = Admission(rules, most, caps, gaps), rules.shares()
    for name, share in shares.items():
        if name == "aesthetic" or a.done():
            continue
        budget, cap = int(rules.max_bytes * share), None if most is None else max(1, int(most * share))
        if name == "people":
            a.fill(rows, budget, cap, lambda r: r["person_id"] >= 0 and r["is_frequent"])
        elif name == "location":
            a.fill(rows, budget, cap, lambda r: not (r["cluster_id"] >= 0 and a.places[r["cluster_id"]] >= caps["location"]), lambda r: a.places.__setitem__(r["cluster_id"], a.places[r["cluster_id"]] + 1))
        else:
            like = lambda r, name=name: (r.get("subjects") or {}).get(name, 0.0)
            matches = sorted((r for r in rows if like(r) >= SUBJECT_MATCH), key=lambda r: -like(r) * r["score"])
            a.fill(matches, budget, cap, lambda r: not a.full_time(r))
    if shares.get("aesthetic", 0) > 0 and not a.done():
        budget, cap = rules.max_bytes - a.bytes, None if most is None else max(1, most - len(a.chosen))
        a.spread(rows, budget, cap)
        a.fill(rows, budget, cap, lambda r: not a.full_time(r))
    if most is not None and len(a.chosen) < most:
        a.round_robin(rows)
    return a.chosen


def select(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """path, pick (1 for the first chosen): the chosen items of (path, score, ...) under the rules."""
    rules.shares()
    own = pool(items, rules).withColumns({"est": est_size(F.col("file_size"), rules.resize, rules.long_side, rules.quality).cast("long"), "day": day_key(), "hour": hour_key()})
    n = own.count()
    most = None if rules.percentage is None else min(max(1, int((rules.total or n) * rules.percentage)), n)
    if rules.min_score_pct > 0:
        floor = own.agg(F.percentile("score", F.lit(rules.min_score_pct)).alias("floor"))
        own = own.crossJoin(F.broadcast(floor)).filter("score >= floor").drop("floor")  # one row
    left, average, clusters, days, hours = own.agg(F.count("*"), F.avg("est"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))), F.countDistinct("day"), F.countDistinct("hour")).first()
    if not left:
        return items.sparkSession.createDataFrame([], "path string, pick int")
    most = None if most is None else min(most, left)
    base = most if most is not None else min(left, int(rules.max_bytes / max(1, average)))
    cap = lambda share: max(1, math.ceil(base * share))
    caps = {"person": cap(rules.per_person), "location": cap(rules.per_location), "cluster": cap(rules.per_cluster) if clusters >= 2 else None}
    caps |= {"day": cap(rules.per_day) if rules.per_day > 0 and days >= 2 else None, "hour": cap(rules.per_hour) if rules.per_hour > 0 and hours >= 2 else None}
    gaps = spacing(own, base / max(1, left), cap(rules.per_cluster), rules.max_spacing)
    narrow = [*NARROW, *(["subjects"] if "subjects" in own.columns else [])]
    rows = own.join(gaps, "cluster_id", "left").select(*narrow, F.coalesce("spacing", F.lit(0.0)).alias("spacing"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["score", "path"], ascending=[False, True], kind="stable")
        chosen = admit(ordered.to_dict("records"), rules, most, caps, dict(zip(pdf.cluster_id, pdf.spacing, strict=True)))
        return pd.DataFrame({"path": [r["path"] for r in chosen], "pick": range(1, len(chosen) + 1)})

    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "path string, pick int")


def report(chosen: DataFrame) -> DataFrame:
    """The report's rows; a name that is taken goes to the first in order, the others get their folder and a number."""
    from sievework.functions.scalars import stem

    parent = F.element_at(F.split("path", "/"), -2)
    named = chosen.withColumns({"_stem": stem(F.col("path")), "_parent": parent})
    first = F.row_number().over(Window.partitionBy("_stem").orderBy("pick"))
    named = named.withColumn("_first", first == 1)
    again = F.row_number().over(Window.partitionBy("_stem", "_parent", "_first").orderBy("pick"))
    name = F.when(F.col("_first"), F.concat("_stem", F.lit(".jpg"))).otherwise(F.concat("_stem", F.lit("__"), "_parent", F.lit("_"), again.cast("string"), F.lit(".jpg")))
    return named.withColumn("filename", name).drop("_stem", "_parent", "_first")
