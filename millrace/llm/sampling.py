"""Problem 2: a sample whose shares match targets over one or several category margins.

1. Records with the same targeted labels form a cell. Iterative proportional fitting finds one factor
   per label so that the cells' inclusion probabilities (the product of their labels' factors, at most
   1) add up to the quota of every label that has enough records.
2. Every cell's expected number is rounded so that the labels of its first margin stay exact. Every
   record draws an exponential key with the rate -ln(1 - probability); a cell gives its records with
   the smallest keys. Ranks come from a histogram of the keys; only the records of the one bucket a
   cell's number ends in are ranked, so no cell is gathered.
3. Repair, before the records are drawn, moves numbers between cells: first along chains of cells that
   differ in one label, which fills a short label from one in excess and leaves all other margins
   alone; then short labels are filled up at the cost of an excess elsewhere; then labels in excess are
   cut back as long as no other quota breaks.
4. The report has quota, available and sampled records, the gap and the excess that stay.

The targets are the statement of the task and are read by the driver, as is one factor per target.
Cells are fitted and repaired on the driver up to CELLS of them. More cells are fitted in the cluster,
with the same result, and repaired from there: chains are looked for over all cells, and the driver
gets the cells of the shortest chains, mends them and writes them back, until there is no chain left.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoints

#: Buckets of the key's range, up to this many rows are broadcast, and cells that the driver holds at once.
BUCKETS, BROADCAST_TARGETS, CELLS = 1 << 14, 100_000, 50_000
#: Rounds of fitting at most, the relative gap at which fitting ends, and rounds without progress after which it ends too.
ROUNDS, TOLERANCE, PATIENCE = 50, 1e-5, 5
CEILING = 1 - 1e-6


def label_key(label: Column) -> Column:
    """Letters and digits without regard to case; null stays null."""
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{N}]+", ""))


def _beside(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TARGETS else df


class Fitting:
    """The factors of iterative proportional fitting; `step` takes what one margin has and moves its factors."""

    def __init__(self, quotas: list):
        rows = [r for r in quotas if r.available > 0]
        self.factor = {(r.margin, r.label): min(CEILING, r.quota / r.available) if r.quota else 0.0 for r in rows}
        self.want = {(r.margin, r.label): min(r.quota, r.available) for r in rows}
        self.margins = sorted({m for m, _ in self.want})

    def step(self, margin: str, got: dict[str, float]) -> float:
        """Scale the factors of one margin to what is wanted; returns the largest relative gap before."""
        worst = 0.0
        for label, g in got.items():
            k = (margin, label)
            if self.factor.get(k, 0.0) > 0 and g > 0:
                ratio = self.want[k] / g
                worst = max(worst, abs(ratio - 1))
                self.factor[k] = min(self.factor[k] * ratio, 1e9)
        return worst

    def run(self, totals) -> dict:
        """totals(margin, factors) gives {label: expected number}; margins are fitted in name order until all are met or no round helps."""
        best, idle = float("inf"), 0
        for _ in range(ROUNDS if self.want else 0):
            worst = max(self.step(m, totals(m, self.factor)) for m in self.margins)
            idle = 0 if worst < best * 0.99 else idle + 1
            best = min(best, worst)
            if worst < TOLERANCE or idle >= PATIENCE:
                break
        return self.factor


def rake_held(cells: list, quotas: list) -> dict:
    """Factor of each (margin, label), from the cells (members, n) in memory."""
    fitting = Fitting(quotas)
    number = {k: i for i, k in enumerate(fitting.want)}
    at = [(c, number[m.margin, m.label]) for c, cell in enumerate(cells) for m in cell.members if (m.margin, m.label) in number]
    cell_of, label_of = (np.array(x, np.int64) for x in zip(*at)) if at else (np.zeros(0, np.int64),) * 2
    n = np.array([c.n for c in cells], float)
    margin_of = np.array([fitting.margins.index(m) for m, _ in number], np.int64)
    labels = [label for _, label in number]

    def totals(margin, factors):
        logs = np.log(np.maximum(np.array([factors[k] for k in number]), 1e-300))
        p = np.minimum(np.exp(np.bincount(cell_of, logs[label_of], len(n))), CEILING)
        own = margin_of[label_of] == fitting.margins.index(margin)
        got = np.bincount(label_of[own], (n * p)[cell_of[own]], len(labels))
        return {labels[i]: got[i] for i in np.unique(label_of[own])}

    return fitting.run(totals)


def rake_spread(cells: DataFrame, quotas: list) -> dict:
    """The same where the cells are too many for the driver: one job per margin and round."""

    def totals(margin, factors):
        weighted = with_probability(cells, factors).select("n", "probability", F.explode("members").alias("m")).filter(F.col("m.margin") == margin)
        return {r.label: r.got for r in weighted.groupBy("m.label").agg(F.sum(F.col("n") * F.col("probability")).alias("got")).collect()}

    return Fitting(quotas).run(totals)


def with_probability(cells: DataFrame, factors: dict) -> DataFrame:
    """The cells with `probability`."""
    table = cells.sparkSession.createDataFrame([(m, x, float(f)) for (m, x), f in factors.items()], "margin string, label string, factor double")
    flat = cells.select("members", "n", F.explode("members").alias("m")).select("members", "n", "m.margin", "m.label")
    p = F.least(F.exp(F.sum(F.log(F.greatest("factor", F.lit(1e-300))))), F.lit(CEILING))
    return flat.join(_beside(table, len(factors)), ["margin", "label"]).groupBy("members", "n").agg(p.alias("probability"))


class Repair:
    """Numbers taken from each cell, moved so that quotas are met. need: quota less sampled of each label, negative in excess."""

    def __init__(self, members: list[tuple], n: list[int], taken: list[int], need: dict[tuple, int]):
        self.members, self.n, self.taken, self.need = members, n, taken, need
        self.by_label, self.by_rest = defaultdict(list), defaultdict(list)
        self.blocked: set[tuple] = set()
        for c, labels in enumerate(members):
            for k in labels:
                self.by_label[k].append(c)
                self.by_rest[k[0], self._rest(c, k)].append((c, k))

    def _rest(self, c: int, k: tuple) -> tuple:
        return tuple(x for x in self.members[c] if x != k)

    def _move(self, c: int, by: int) -> None:
        self.taken[c] += by
        for k in self.members[c]:
            self.need[k] -= by

    def fill(self, force: bool = False) -> None:
        """Fill short labels up, from cells whose other labels are short too or, by force, from any that have records left."""
        for k in sorted((k for k, v in self.need.items() if v > 0), key=lambda k: (-self.need[k], k)):
            for c in sorted(self.by_label[k], key=lambda c: (sum(self.need[x] <= 0 for x in self.members[c]), c)):
                room = self.n[c] - self.taken[c]
                by = min(self.need[k] if force else min(self.need[x] for x in self.members[c]), room)
                if by > 0:
                    self._move(c, by)
                if self.need[k] <= 0:
                    break

    def cut(self) -> None:
        """Cut labels in excess back, in cells all of whose labels are in excess."""
        for k in sorted((k for k, v in self.need.items() if v < 0), key=lambda k: (self.need[k], k)):
            for c in self.by_label[k]:
                by = min(min(-self.need[x] for x in self.members[c]), self.taken[c])
                if by > 0:
                    self._move(c, -by)

    def _room(self, c: int, sign: int) -> int:
        return self.n[c] - self.taken[c] if sign > 0 else self.taken[c]

    def exchange(self, sign: int) -> None:
        """Mend short labels (sign 1) or labels in excess (sign -1) along the shortest chains of cells with the same other labels.

        A chain ends at a label of the same margin with the opposite fault, or in a cell whose other
        labels all have the same fault. Labels between have what they had.
        """
        for k in sorted(k for k, v in self.need.items() if sign * v > 0):
            while sign * self.need[k] > 0:
                steps, end, last = self._chain(k, sign)
                if end is None:
                    break
                moves = Counter(c for c, _ in steps)
                moves.subtract(d for _, d in steps)
                limits = [sign * self.need[k]]
                if last is None:
                    limits.append(-sign * self.need[end])
                else:
                    moves[last] += 1
                    limits += [sign * self.need[x] for x in self.members[last] if x != end]
                # a record with two labels of a margin can let a cell appear twice
                by = min(limits + [self._room(c, sign if m > 0 else -sign) // abs(m) for c, m in moves.items() if m])
                if by <= 0:
                    self.blocked.add(k)
                    break
                for c, m in moves.items():
                    self._move(c, sign * by * m)

    def _chain(self, start: tuple, sign: int) -> tuple[list[tuple[int, int]], tuple | None, int | None]:
        """(pairs of cells, one moved by sign and one by -sign; the label at the end; the single cell moved there, if any); no label if there is no chain."""
        came: dict[tuple, tuple | None] = {start: None}
        waiting = deque([start])
        while waiting:
            k = waiting.popleft()
            last = None
            if sign * self.need[k] >= 0:
                last = next((c for c in self.by_label[k] if self._room(c, sign) and all(sign * self.need[x] > 0 for x in self.members[c] if x != k)), None)
            if last is not None or sign * self.need[k] < 0:
                end, steps = k, []
                while came[k]:
                    k, c, d = came[k]
                    steps.append((c, d))
                return steps, end, last
            for c in self.by_label[k]:
                if self._room(c, sign):
                    for d, other in self.by_rest[k[0], self._rest(c, k)]:
                        if other not in came and self._room(d, -sign):
                            came[other] = (k, c, d)
                            waiting.append(other)
        return [], None, None

    def run(self) -> list[int]:
        self.fill()
        self.exchange(1)
        self.cut()
        self.exchange(-1)
        self.fill(force=True)
        self.cut()
        self.exchange(-1)
        return self.taken


def _lookup(numbers: list[int]):
    """The number at a code, for columns of codes; null at codes beyond."""
    table = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")
    return lambda code: F.get(table, code)


class SpreadRepair:
    """The same repair where the cells are too many for the driver.

    cells: members, n, taken and further columns. Labels are numbered by codes. The driver gets at most
    `held` cells at once, or three per label if that is more; every round takes records or moves them
    and none adds to the faults, so rounds end where no cell of all is left that helps.
    """

    def __init__(self, cells: DataFrame, need: dict[tuple, int], held: int):
        self.spark, self.need, self.held, self.keys = cells.sparkSession, need, held, sorted(need)
        margins = {m: i for i, m in enumerate(sorted({m for m, _ in need}))}
        self.margin_of = _lookup([margins[m] for m, _ in self.keys])
        table = self.spark.createDataFrame([(i, m, x) for i, (m, x) in enumerate(self.keys)], "code int, margin string, label string")
        flat = cells.select("members", F.explode("members").alias("m")).select("members", "m.margin", "m.label")
        codes = flat.join(_beside(table, len(self.keys)), ["margin", "label"]).groupBy("members").agg(F.sort_array(F.collect_list("code")).alias("codes"))
        self.cells = cells.join(codes, "members").checkpoint()

    def _faulty(self, sign: int) -> list[int]:
        return [i for i, k in enumerate(self.keys) if sign * self.need[k] > 0]

    def _mend(self, picked: DataFrame, step) -> tuple[bool, set[tuple]]:
        """Let the repair on the driver do the step with the picked cells; (whether it moved anything, the labels whose chains are blocked)."""
        rows = picked.select("codes", "n", "taken").distinct().orderBy(F.desc("n"), "codes").collect()
        repair = Repair([tuple(self.keys[i] for i in r.codes) for r in rows], [r.n for r in rows], [r.taken for r in rows], self.need)
        step(repair)
        moved = [(r.codes, k) for r, k in zip(rows, repair.taken, strict=True) if k != r.taken]
        if moved:
            mended = self.spark.createDataFrame(moved, "codes array<int>, mended long")
            self.cells = self.cells.join(_beside(mended, len(moved)), "codes", "left").withColumn("taken", F.coalesce("mended", "taken")).drop("mended").checkpoint()
        return bool(moved), repair.blocked

    def _chains(self, starts: list[int], sign: int) -> DataFrame | None:
        """The cells of shortest chains, as in Repair.exchange, from the starts, some for every label met on the way; None if there is no chain."""
        if not starts:
            return None
        need = _lookup([sign * self.need[k] for k in self.keys])
        room = lambda c, way: c["n"] - c["taken"] if way > 0 else c["taken"]
        cell = {"codes": F.col("codes"), "n": F.col("n"), "taken": F.col("taken")}
        sound = self.cells.filter(room(cell, sign) > 0).select("codes", "n", "taken", F.filter("codes", lambda x: need(x) <= 0).alias("sound"))
        ending = F.when(F.size("sound") == 0, F.col("codes")).when((F.size("sound") == 1) & (need(F.get("sound", F.lit(0))) == 0), F.col("sound"))
        single = sound.select("codes", "n", "taken", room(cell, sign).alias("room"), F.explode(ending).alias("end"))
        ends = {r.end for r in single.select("end").distinct().collect()} | set(self._faulty(-sign))

        level, last, depth, groups = dict.fromkeys(starts, 0), set(starts), 0, None
        while last and not last & ends:
            if groups is None:
                groups = self._groups().checkpoint()
            at = _lookup([level.get(i, -1) for i in range(len(self.keys))])
            source = F.exists("own", lambda o: (room(o, sign) > 0) & (at(o["code"]) == depth))  # noqa: B023
            unseen = F.filter("own", lambda o: (room(o, -sign) > 0) & (at(o["code"]) < 0))  # noqa: B023
            last = {r.code for r in groups.filter(source).select(F.explode(unseen).alias("o")).select("o.code").distinct().collect()}
            depth += 1
            level.update(dict.fromkeys(last, depth))
        if not last:
            return None
        most = max(1, self.held // (3 * len(level)))
        at = _lookup([level.get(i, -1) for i in range(len(self.keys))])
        picked = self._first(single.filter(at(F.col("end")) >= 0), most, F.desc("room"), "codes").select("codes", "n", "taken")
        if depth:
            pairs = groups.select("rest", "own", F.explode(F.filter("own", lambda o: (room(o, -sign) > 0) & (at(o["code"]) > 0))).alias("d"))
            before = F.filter("own", lambda o: (room(o, sign) > 0) & (at(o["code"]) == at(F.col("d")["code"]) - 1))
            best = F.array_max(F.transform(before, lambda o: F.struct(room(o, sign).alias("room"), o["code"].alias("code"), o["n"].alias("n"), o["taken"].alias("taken"))))
            pairs = pairs.select("rest", "d", F.col("d.code").alias("end"), best.alias("c")).filter("c is not null").withColumn("room", F.least("c.room", room(F.col("d"), -sign)))
            pairs = self._first(pairs, most, F.desc("room"), "rest")
            pairs = pairs.select("rest", F.explode(F.array(*(F.struct(*(f"{x}.{y}" for y in ("code", "n", "taken"))) for x in "cd"))).alias("o"))
            picked = picked.unionByName(pairs.select(F.array_sort(F.concat("rest", F.array("o.code"))).alias("codes"), "o.n", "o.taken"))
        return picked

    def _groups(self) -> DataFrame:
        """The cells that differ in one label of a margin: (rest, own), rest being what they share."""
        each = self.cells.select("codes", "n", "taken", F.explode("codes").alias("code"))
        own = F.collect_list(F.struct("code", "n", "taken")).alias("own")
        return each.groupBy(self.margin_of(F.col("code")).alias("margin"), F.array_remove("codes", F.col("code")).alias("rest")).agg(own).filter(F.size("own") > 1)

    def _first(self, df: DataFrame, most: int, *order) -> DataFrame:
        """At most so many rows of each `end`."""
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("end").orderBy(*order))).filter(F.col("rank") <= most)

    def exchange(self, sign: int) -> None:
        step = lambda repair: (repair.fill() if sign > 0 else repair.cut(), repair.exchange(sign))
        stuck: set[tuple] = set()
        while (picked := self._chains([i for i in self._faulty(sign) if self.keys[i] not in stuck], sign)) is not None:
            moved, blocked = self._mend(picked, step)
            # a chain that needs a cell twice, as records with two labels of a margin allow, mustn't hold up other starts
            if not moved:
                if blocked <= stuck:
                    break
                stuck |= blocked

    def fill(self) -> None:
        """Fill short labels up by force."""
        while short := self._faulty(1):
            need = _lookup([self.need[k] for k in self.keys])
            most = max(1, self.held // len(short))
            sound = F.size(F.filter("codes", lambda x: need(x) <= 0))  # noqa: B023
            free = self.cells.filter("n > taken").select("codes", "n", "taken", sound.alias("sound"), F.explode(F.filter("codes", lambda x: need(x) > 0)).alias("end"))  # noqa: B023
            if not self._mend(self._first(free, most, "sound", F.desc("n"), "codes"), lambda repair: repair.fill(force=True))[0]:
                break

    def run(self) -> DataFrame:
        """The cells with what is taken from each."""
        self.exchange(1)
        self.exchange(-1)
        self.fill()
        self.exchange(-1)
        return self.cells.drop("codes")


def sample_to_targets(memberships: DataFrame, targets: DataFrame, sample_share: float = 0.5, seed: int = 7, held: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Sample records so that each label gets its share; returns (sample, report).

    memberships: (id, margin, label), any number of rows per record and margin; nulls and repeated
    rows don't count. targets: (margin, label, target_share, min_count); further columns come out in
    the report. Records with a label make up the population; a label's quota is the larger of
    min_count and target_share times sample_share times the population, rounded. Labels without a
    target are never sampled for themselves; targets without records are reported with all their gap.

    sample: (id, probability), one row per sampled record, probability being what fitting gave its
    cell. report: the targets' columns with quota, available, sampled, gap (what is missing) and
    excess. Quotas count as minimums first: where margins contradict each other, no label that has
    enough records falls short, and the others' excess is reported. The same seed gives the same
    sample. held: cells the driver holds at once, see the module.
    """
    spark = memberships.sparkSession
    ensure_checkpoints(spark)
    asked = targets.select("margin", "label").filter("label is not null").distinct()
    n_asked = asked.count()
    member = F.struct(F.col("margin"), F.col("label"))
    marked = memberships.select("id", "margin", "label").filter("id is not null and label is not null").join(_beside(asked.withColumn("asked", F.lit(True)), n_asked), ["margin", "label"], "left")
    records = marked.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("asked"), member))).alias("members")).checkpoint()
    population = records.count()
    quota = F.greatest(F.coalesce(F.col("min_count"), F.lit(0)).cast("double"), F.round(F.coalesce("target_share", F.lit(0.0)) * (sample_share * population))).cast("long")

    cells = records.filter(F.size("members") > 0).groupBy("members").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    n_cells = cells.count()
    flat = lambda df, *columns: df.select(*columns, F.explode("members").alias("m")).select(*columns, "m.margin", "m.label")
    available = flat(cells, "n").groupBy("margin", "label").agg(F.sum("n").alias("available"))
    quotas = targets.withColumn("quota", quota).join(available, ["margin", "label"], "left").withColumn("available", F.coalesce("available", F.lit(0))).checkpoint()
    wanted = quotas.filter("label is not null").groupBy("margin", "label").agg(F.max("quota").alias("quota"), F.max("available").alias("available")).collect()
    factors = rake_held(cells.collect(), wanted) if n_cells <= held else rake_spread(cells, wanted)

    expected = F.when(F.col("probability") >= CEILING, F.col("n")).otherwise(F.col("n") * F.col("probability"))
    along = Window.partitionBy(F.col("members")[0]).orderBy("members")
    upto = lambda w: F.floor(F.coalesce(F.sum("expected").over(w), F.lit(0.0)) + 0.5)
    rounded = with_probability(cells, factors).withColumn("expected", expected)
    taken = upto(along.rowsBetween(Window.unboundedPreceding, 0)) - upto(along.rowsBetween(Window.unboundedPreceding, -1))
    rounded = rounded.withColumn("taken", F.least(taken, F.col("n"))).checkpoint()
    got = {(r.margin, r.label): r.got for r in flat(rounded, "taken").groupBy("margin", "label").agg(F.sum("taken").alias("got")).collect()}
    need = {(r.margin, r.label): min(r.quota, r.available) - got.get((r.margin, r.label), 0) for r in wanted if r.available}
    if n_cells <= held:
        rows = sorted(rounded.select("members", "n", "taken").collect(), key=lambda r: (-r.n, r.members))
        repair = Repair([tuple((m.margin, m.label) for m in r.members) for r in rows], [r.n for r in rows], [r.taken for r in rows], need)
        moved = [(r.members, k) for r, k in zip(rows, repair.run(), strict=True) if k != r.taken]
        mended = spark.createDataFrame(moved, f"members {rounded.schema['members'].dataType.simpleString()}, mended long")
        repaired = rounded.join(_beside(mended, len(moved)), "members", "left").withColumn("taken", F.coalesce("mended", "taken"))
    else:
        repaired = SpreadRepair(rounded, need, held).run()
    shares = repaired.select("members", "probability", "taken")

    # within a cell the keys are in the order of this number, since all have one rate
    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(uniform) / -F.log1p(-F.col("probability"))
    bucket = F.floor((1 - uniform) * BUCKETS).cast("int")
    keyed = records.join(_beside(shares.filter("taken > 0"), n_cells), "members").select("id", "members", "probability", "taken", key.alias("key"), bucket.alias("bucket"))
    counted = keyed.groupBy("members", "taken", "bucket").agg(F.count(F.lit(1)).alias("n"))
    filled = F.sum("n").over(Window.partitionBy("members").orderBy("bucket"))
    edge = counted.withColumn("filled", filled).filter("filled >= taken and filled - n < taken").select("members", F.col("bucket").alias("edge"), (F.col("taken") - (F.col("filled") - F.col("n"))).alias("open"))
    placed = keyed.join(_beside(edge, n_cells), "members")
    rank = F.row_number().over(Window.partitionBy("members").orderBy("key", "id"))
    at_edge = placed.filter("bucket = edge").withColumn("rank", rank).filter("rank <= open")
    drawn = placed.filter("bucket < edge").select("id", "members", "probability").unionByName(at_edge.select("id", "members", "probability"))

    sampled = flat(drawn, "id").groupBy("margin", "label").agg(F.count(F.lit(1)).alias("sampled"))
    report = quotas.join(sampled, ["margin", "label"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    over = F.col("sampled") - F.col("quota")
    return drawn.select("id", "probability"), report.withColumns({"gap": F.greatest(-over, F.lit(0)), "excess": F.greatest(over, F.lit(0))})


def sample_categories(rows: DataFrame, targets: DataFrame, record: str = "docno", cat: str = "cat", **options) -> tuple[DataFrame, DataFrame]:
    """sample_to_targets for a token table with one label column and targets (cat, target_share, min_docs).

    Labels are compared by label_key. Rows with null record or label don't count.
    """
    pairs = rows.select(F.col(record).alias("id"), F.col(cat).alias("raw")).filter("id is not null and raw is not null").distinct()
    wanted = targets.select("cat", "target_share", F.col("min_docs").alias("min_count"), F.lit("cat").alias("margin"), label_key(F.col("cat")).alias("label"))
    return sample_to_targets(pairs.select("id", F.lit("cat").alias("margin"), label_key(F.col("raw")).alias("label")), wanted, **options)


def sample_categories_and_periods(rows: DataFrame, targets: DataFrame, record: str = "docno", cat: str = "cat", time: str = "loaded_at", **options) -> tuple[DataFrame, DataFrame]:
    """sample_to_targets over two margins: the categories with their targets, and equal shares of the quarters of the records' first load.

    A record whose times are all null has no quarter. Columns of the report: margin, label, quota,
    available, sampled, gap, excess; labels of categories are their label_key.
    """
    labels = rows.select(F.col(record).alias("id"), label_key(F.col(cat)).alias("label")).filter("id is not null and label is not null").distinct()
    first = rows.filter(F.col(record).isNotNull()).groupBy(F.col(record).alias("id")).agg(F.min(time).alias("first")).filter("first is not null")
    quarter = F.concat_ws("-", F.year("first"), F.concat(F.lit("q"), F.quarter("first")))
    periods = first.select("id", F.lit("quarter").alias("margin"), quarter.alias("label"))
    wanted = targets.select(F.lit("cat").alias("margin"), label_key(F.col("cat")).alias("label"), "target_share", F.col("min_docs").alias("min_count"))
    seen = periods.select("margin", "label").distinct()
    share = 1 / F.count(F.lit(1)).over(Window.partitionBy("margin"))  # one row a quarter
    wanted = wanted.unionByName(seen.select("margin", "label", share.alias("target_share"), F.lit(0).alias("min_count")))
    sample, report = sample_to_targets(labels.select("id", F.lit("cat").alias("margin"), "label").unionByName(periods), wanted, **options)
    return sample, report.select("margin", "label", "quota", "available", "sampled", "gap", "excess")
