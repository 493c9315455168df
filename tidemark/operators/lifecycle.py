"""One structural movement at a time in each series: which candidate takes the place, and what befalls it, as a log.

A gap ends everything, so a segment of complete bars is on its own. Within it, all is derived from the bars by joins:

1. each accepted pivot makes a triple (the pivot before the last, the last, itself) that lives until the next one; the
   first close in that time that newly crosses the middle one, with the base untested so far, makes it a candidate;
2. what would befall a candidate if it had the place (base lost, base tested, opposite structure, final extreme, return to
   it) are first contacts after its birth, and do not depend on other candidates;
3. so every candidate has one successor: the first later candidate that may follow it, whether the place is free by then
   or held by a suspended movement. Those that take the place are the chain of successors from a segment's first;
4. the log is then read off the bars of each movement's time.

Order within one close: final extreme, loss, test, return, opposite structure, use; then candidates; then the close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import COMPLETE
from tidemark.operators.observe import by_segment
from tidemark.operators.search import chain, first_reach
from tidemark.sources.shared import materialize

FORMING, USABLE, SUSPENDED_KNOWN, SUSPENDED_FORMING, ABSENT = "FORMING", "USABLE", "SUSPENDED_WITH_P1", "SUSPENDED_WITHOUT_P1", "ABSENT"
KEY = ["series", "segment"]
#: Place of each kind of fact within a close.
ORDER = {"known": 1, "lost": 2, "tested": 3, "reached": 4, "opposite": 5, "usable": 6, "candidate": 7, "birth": 8, "born": 9, "close": 10, "end": 11}


def _beyond(price: Column, level: Column) -> Column:
    """How far a price is beyond a level, in the movement's direction."""
    return F.col("d") * (price - level)


def triples(sequence: DataFrame) -> DataFrame:
    """The triple that each accepted pivot makes: series, segment, t0, version, d, base, extreme and its soundness."""
    island = Window.partitionBy("series", "segment", "island").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    before = sequence.withColumn("__q", F.lag("p0").over(by_segment())).withColumn("q", F.first("__q").over(island))
    found = before.filter("action <> 'KEEP' and q is not null").withColumn("d", F.when(F.col("kind") == "LOW", 1).otherwise(-1))
    sound = (_beyond(F.col("price"), F.col("q.price")) > 0) & (_beyond(F.col("p0.price"), F.col("price")) > 0)
    return found.select(
        "series", "t0", "version", "d", F.col("price").alias("base"), F.col("c0").alias("base_t0"),
        F.col("p0.price").alias("extreme"), F.col("p0.c0").alias("extreme_t0"), sound.alias("sound"),
    )


def candidates(bars: DataFrame, sequence: DataFrame) -> DataFrame:
    """Sound triples whose extreme a close newly crosses before their base is tested: k is that bar's position."""
    accepted = sequence.filter("action <> 'KEEP'").select("series", "t0", F.col("version").alias("fresh"))
    live = bars.join(accepted, ["series", "t0"], "left").withColumn("version", F.last("fresh", ignorenulls=True).over(by_segment()))
    live = live.withColumn("before", F.lag("c").over(by_segment())).join(triples(sequence).filter("sound").drop("t0"), ["series", "version"])
    crossed = (_beyond(F.col("before"), F.col("extreme")) <= 0) & (_beyond(F.col("c"), F.col("extreme")) > 0)
    tested = _beyond(F.when(F.col("d") == 1, F.col("l")).otherwise(F.col("h")), F.col("base")) <= 0
    same = [*KEY, "version", "d", "base", "base_t0", "extreme", "extreme_t0"]
    found = live.groupBy(*same).agg(F.min(F.when(crossed, F.struct("pos", "t0", "t1"))).alias("at"), F.min(F.when(tested, F.col("pos"))).alias("tested"))
    found = found.filter("at is not null and (tested is null or tested > at.pos)")
    idx = F.row_number().over(Window.partitionBy(*KEY).orderBy("at.pos")).cast("long")
    side = F.when(F.col("d") == 1, "LONG").otherwise("SHORT")
    return found.select(
        *KEY, idx.alias("idx"), "d", side.alias("side"), "base", "base_t0", "extreme", F.col("at.pos").cast("long").alias("k"),
        F.concat_ws(":", side, F.col("extreme_t0").cast("string"), F.col("base_t0").cast("string"), F.col("at.t1").cast("string")).alias("ref_id"),
    )


def _contacts(bars: DataFrame, asks: DataFrame, kinds: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """For each candidate, the first position of every kind: name -> (value of a bar, position after which, level)."""
    both = bars.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("d"))
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("double").alias("value")) for n, (v, _, _) in kinds.items()]))
    rows = both.select(*KEY, "pos", "d", values.alias("x")).select(*KEY, "pos", "d", "x.kind", "x.value")
    wanted = [F.struct(F.lit(n).alias("kind"), a.cast("long").alias("after"), lv.cast("double").alias("level")) for n, (_, a, lv) in kinds.items()]
    asked = asks.select(*KEY, "idx", "d", F.explode(F.array(*wanted)).alias("x")).select(*KEY, "idx", "d", "x.*", (F.col("x.kind") == "known").alias("strict"))
    hits = first_reach(rows, asked, [*KEY, "d", "kind"])
    return hits.groupBy(*KEY, "idx").agg(*[F.max(F.when(F.col("kind") == n, F.col("hit"))).alias(n) for n in kinds])


def lives(bars: DataFrame, found: DataFrame, sequence: DataFrame) -> DataFrame:
    """Candidates with what would befall them: positions known, lost, tested, opposite, reached, suspended and over.

    ``anchor`` is the final extreme: the first accepted pivot beyond the extreme whose bar is not before the birth.
    """
    edge = lambda near: F.when((F.col("d") == 1) == near, F.col("h")).otherwise(F.col("l"))
    pivot = sequence.filter("action <> 'KEEP'").select(
        "series", F.col("c0").alias("t0"), F.col("t0").alias("known_t0"), F.col("kind").alias("pivot"), F.col("price").alias("pivot_at")
    )
    rows = bars.join(pivot, ["series", "t0"], "left")
    final = F.when(F.col("pivot") == F.when(F.col("d") == 1, "HIGH").otherwise("LOW"), F.col("d") * F.col("pivot_at"))
    opposite = F.when(F.col("structure") == F.when(F.col("d") == 1, "DOWN").otherwise("UP"), 1.0)
    k, base = F.col("k"), -F.col("d") * F.col("base")
    met = found.join(
        _contacts(
            rows,
            found,
            {
                "lost": (-F.col("d") * F.col("c"), k, base),
                "tested": (-F.col("d") * edge(False), k, base),
                "opposite": (opposite, k - 1, F.lit(1.0)),
                "known": (final, k - 1, F.col("d") * F.col("extreme")),
            },
        ),
        [*KEY, "idx"],
    )
    # The pivot is known some bars after its own.
    place = bars.select("series", F.col("t0").alias("known_t0"), F.col("pos").alias("known_pos"))
    known = rows.filter("pivot is not null").join(place, ["series", "known_t0"])
    known = known.select(*KEY, F.col("pos").alias("known"), "known_pos", F.col("pivot_at").alias("anchor"))
    met = met.join(known, [*KEY, "known"], "left").drop("known").withColumnRenamed("known_pos", "known")
    met = materialize(met)
    back = _contacts(bars, met, {"reached": (F.col("d") * edge(True), F.col("known"), F.col("d") * F.col("anchor"))})
    met = met.join(back, [*KEY, "idx"])
    never = F.lit((1 << 62))
    at = {n: F.coalesce(n, never) for n in ("lost", "tested", "opposite", "reached")}
    whole = (at["reached"] < at["tested"]) & (at["reached"] <= at["opposite"]) & (at["opposite"] > k)
    stop = F.least(at["tested"], at["opposite"])
    met = met.withColumn("completed", whole).withColumn("over", F.when(whole, F.col("reached")).otherwise(F.col("lost")))
    return met.withColumn("suspended", F.when(~whole & (stop < at["lost"]) & (stop < never), stop)).drop("reached", "opposite")


def successors(bars: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with next: the first candidate that may take the place after each, if it had it.

    A place that fell free is taken by a base that is newer than the lost close, or than the completed movement's own
    base; a suspended movement is replaced by a base that is newer than its suspension.
    """
    born = found.groupBy(*KEY, F.col("k").alias("pos")).agg(F.count(F.lit(1)).alias("born"))
    based = found.groupBy("series", F.col("base_t0").alias("t0")).agg(F.count(F.lit(1)).alias("based"))
    counts = bars.join(born, [*KEY, "pos"], "left").join(based, ["series", "t0"], "left").select(
        *KEY, F.col("pos").cast("long").alias("pos"), "t0",
        F.sum(F.coalesce("born", F.lit(0))).over(by_segment()).alias("born"), F.sum(F.coalesce("based", F.lit(0))).over(by_segment()).alias("based"),
    )
    counts = materialize(counts)
    base = found.join(counts.select(*KEY, F.col("t0").alias("base_t0"), F.col("pos").alias("base_pos")), [*KEY, "base_t0"])
    limit = F.when(F.col("completed"), F.col("base_pos")).otherwise(F.col("over"))
    asks = F.array(*[F.struct(F.lit(n).alias("what"), p.alias("pos")) for n, p in (("over_k", F.col("over") - 1), ("over_b", limit), ("held_k", F.col("suspended") - 1), ("held_b", F.col("suspended")))])
    asked = base.select(*KEY, "idx", F.explode(asks).alias("x")).select(*KEY, "idx", "x.*").filter("pos is not null").join(counts.drop("t0"), [*KEY, "pos"])
    pick = lambda n: F.max(F.when(F.col("what") == n, F.col("born" if n[-1] == "k" else "based")))
    after = asked.groupBy(*KEY, "idx").agg(
        (F.greatest(pick("over_k"), pick("over_b")) + 1).alias("free"), (F.greatest(pick("held_k"), pick("held_b")) + 1).alias("instead")
    )
    of = found.select(*KEY, F.col("idx").alias("instead"), F.col("k").alias("instead_k"))
    last = found.groupBy(*KEY).agg(F.max("idx").alias("last"))
    met = found.join(after, [*KEY, "idx"], "left").join(of, [*KEY, "instead"], "left").join(last, KEY)
    replaced = F.col("instead_k").isNotNull() & (F.col("over").isNull() | (F.col("instead_k") < F.col("over")))
    pointer = F.when(replaced, F.col("instead")).when(F.col("over").isNotNull(), F.col("free"))
    met = met.withColumn("next", F.when(pointer <= F.col("last"), pointer)).withColumn("replaced", F.when(replaced, F.col("instead_k")))
    return met.drop("instead", "instead_k", "free", "last")


def _fact(order: str, kind: str | Column, reason: str | Column | None, when: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    reason = F.lit("") if reason is None else text(reason)
    return F.when(when, F.struct(F.lit(ORDER[order]).alias("seq"), text(kind).alias("type"), reason.alias("reason")))


def lifecycle(observed: DataFrame, sequence: DataFrame) -> DataFrame:
    """The log of each series: BIRTH, P1_PUBLISHED, USABLE, SUSPENSION, FACT, REJECTED, ARCHIVE, OPEN_AT_END, and one
    CLOSE for each complete bar with the condition of the place. ``seq`` orders the facts of one close."""
    by_time = Window.partitionBy("series").orderBy("t0")
    after = F.lead("t1").over(by_time)
    bars = materialize(observed.withColumn("after", after).filter(F.col("status") == COMPLETE).select("series", "segment", "t0", "t1", "pos", "h", "l", "c", "structure", "after"))
    sequence = materialize(sequence)
    found = materialize(candidates(bars, sequence))
    found = materialize(successors(bars, materialize(lives(bars, found, sequence))))
    taken = chain(found.select(*KEY, "idx", "next"), KEY).withColumn("taken", F.lit(True))
    found = materialize(found.join(taken, [*KEY, "idx"], "left"))
    struct = F.struct(*[c for c in found.columns if c not in (*KEY, "taken", "next", "idx")]).alias("new")
    new = found.filter("taken").select(*KEY, F.col("k").alias("pos"), struct)
    rest = found.filter("taken is null").select(*KEY, F.col("k").alias("pos"), F.col("base").alias("turned_base"), F.col("base_t0").alias("turned_t0"))
    rows = bars.join(new, [*KEY, "pos"], "left").join(rest, [*KEY, "pos"], "left")
    past = by_segment().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("o", F.last("new", ignorenulls=True).over(past)).withColumn("was", F.lag("structure").over(by_segment()))
    pos, held = F.col("pos"), F.col("o.k").isNotNull() & (F.col("pos") <= F.coalesce("o.over", "pos"))
    rows = rows.withColumn("o", F.when(held, F.col("o"))).withColumn("last", F.row_number().over(by_segment()) == F.count(F.lit(1)).over(Window.partitionBy(*KEY)))

    up = F.col("o.d") == 1
    near, far = F.when(up, F.col("l")).otherwise(F.col("h")), F.when(up, F.col("h")).otherwise(F.col("l"))
    reaches = lambda price, level: F.coalesce(F.col("o.d") * (price - F.col(level)) <= 0, F.lit(False))
    over = F.coalesce(F.col("o.over") == pos, F.lit(False))
    lost, done = over & ~F.col("o.completed"), over & F.col("o.completed")
    tested = reaches(near, "o.base") & ~lost & F.col("o.k").isNotNull()
    touched = F.coalesce((F.col("o.known") < pos) & (F.col("o.d") * (far - F.col("o.anchor")) >= 0), F.lit(False)) & ~lost & ~tested & ~done
    against = F.when(up, "DOWN").otherwise("UP")
    opposite = F.coalesce(F.col("structure") == against, F.lit(False)) & ~over & F.col("o.k").isNotNull()
    onset = ~F.coalesce(F.col("was") == against, F.lit(False))
    first = F.coalesce(F.col("o.suspended") == pos, F.lit(False))
    fresh = F.coalesce(F.col("o.known") == pos, F.lit(False))
    free = F.coalesce(F.col("o.suspended") > pos, F.lit(True))
    replaced = F.coalesce(F.col("o.replaced") == pos, F.lit(False))
    stays = F.col("o.k").isNotNull() & ~over
    turned = F.col("turned_base").isNotNull()
    unknown = F.coalesce(F.col("o.known") > pos, F.lit(True))
    refusal = F.when(~stays | ~free, "NOT_FRESH").when(unknown, "OCCUPIED_FORMING").otherwise("OCCUPIED_USABLE")
    judged = [
        _fact("known", "P1_PUBLISHED", None, fresh),
        _fact("lost", "ARCHIVE", "BASE_LOST", lost),
        _fact("tested", F.when(first, "SUSPENSION").otherwise("FACT"), "BASE_TESTED", tested),
        _fact("reached", "ARCHIVE", "EXTREME_REACHED", done),
        _fact("reached", "FACT", "P1_TOUCHED_WHILE_SUSPENDED", touched),
        _fact("opposite", F.when(first & ~tested, "SUSPENSION").otherwise("FACT"), "OPPOSITE_STRUCTURE", opposite & ((first & ~tested) | onset)),
        _fact("usable", "USABLE", None, fresh & free & ~over),
        _fact("candidate", "ARCHIVE", "REPLACED", replaced),
        _fact("candidate", "REJECTED", refusal, turned),
    ]
    end = lambda who: [
        _fact("close", "CLOSE", None, F.lit(True)),
        _fact("end", F.when(F.col("after").isNull(), "OPEN_AT_END").otherwise("ARCHIVE"), F.when(F.col("after").isNull(), "").otherwise("CONTINUITY_INTERRUPTED"), who & F.col("last")),
    ]
    begun = [_fact("birth", "BIRTH", None, F.lit(True)), _fact("born", "SUSPENSION", "OPPOSITE_STRUCTURE_AT_BIRTH", F.coalesce(F.col("new.suspended") == pos, F.lit(False)))]
    keeps = stays & ~replaced
    before = _log(rows, "o", judged, F.col("o.k").isNotNull() | turned)
    after_ = _log(rows.withColumn("m", F.coalesce("new", F.when(keeps, F.col("o")))), "m", end(F.col("m.k").isNotNull()), F.lit(True))
    return before.unionByName(_log(rows, "new", begun, F.col("new.k").isNotNull())).unionByName(after_)


def _log(rows: DataFrame, who: str, facts: list[Column], wanted: Column) -> DataFrame:
    """Rows of the log about the movement ``who`` of each bar; a rejected candidate's row has its own base."""
    made = rows.filter(wanted).withColumn("f", F.explode(F.filter(F.array(*facts), lambda x: x.isNotNull())))
    kind, reason, pos = F.col("f.type"), F.col("f.reason"), F.col("pos")
    # A movement that ended with this close is not there for what follows.
    gone = (F.col(f"{who}.over") == pos) & (F.col("f.seq") > ORDER["usable"])
    m = lambda c: F.when(~F.coalesce(gone, F.lit(False)), F.col(f"{who}.{c}"))
    turned = kind == "REJECTED"
    known = F.coalesce(m("known") <= pos, F.lit(False))
    early = (kind == "P1_PUBLISHED") | ((kind == "ARCHIVE") & reason.isin("BASE_LOST", "EXTREME_REACHED"))
    stopped = F.coalesce(F.when(early, m("suspended") < pos).otherwise(m("suspended") <= pos), F.lit(False))
    condition = F.when(stopped, F.when(known, SUSPENDED_KNOWN).otherwise(SUSPENDED_FORMING)).otherwise(F.when(known, USABLE).otherwise(FORMING))
    late = (F.col("f.seq") == ORDER["end"]) & (kind == "ARCHIVE")
    return made.select(
        "series",
        F.when(late, F.col("after")).otherwise(F.col("t1")).alias("t"),
        F.col("f.seq").alias("seq"),
        kind.alias("type"),
        m("ref_id").alias("ref_id"),
        m("side").alias("side"),
        reason.alias("reason"),
        F.when(m("ref_id").isNull(), ABSENT).otherwise(condition).alias("condition"),
        F.when(turned, F.col("turned_base")).otherwise(m("base")).alias("base"),
        m("extreme").alias("extreme"),
        F.when(known, m("anchor")).alias("anchor"),
        F.when(turned, F.col("turned_t0")).otherwise(m("base_t0")).alias("base_t0"),
    )


def violations(log: DataFrame, observed: DataFrame) -> DataFrame:
    """What the log states but the bars do not bear out: (ref_id, rule). There should be no row."""
    bars = observed.select("series", F.col("t1").alias("t"), "h", "l", "c")
    met = log.filter("ref_id is not null").join(bars, ["series", "t"], "left")
    d = F.when(F.col("side") == "LONG", 1).otherwise(-1)
    lost = (F.col("type") == "ARCHIVE") & (F.col("reason") == "BASE_LOST") & ~(d * (F.col("c") - F.col("base")) <= 0)
    edge = F.when(d == 1, F.col("h")).otherwise(F.col("l"))
    reached = (F.col("type") == "ARCHIVE") & (F.col("reason") == "EXTREME_REACHED") & ~F.coalesce(d * (edge - F.col("anchor")) >= 0, F.lit(False))
    born = (F.col("type") == "BIRTH") & ~(d * (F.col("c") - F.col("extreme")) > 0)
    held = (F.col("type") == "CLOSE") & (d * (F.col("c") - F.col("base")) <= 0)
    rules = F.array(F.when(lost, "loss without a close beyond the base"), F.when(reached, "end without the extreme"), F.when(born, "birth without a crossing"), F.when(held, "close beyond the base not recorded"))
    rows = met.select("ref_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    spans = log.filter("ref_id is not null").groupBy("series", "ref_id").agg(
        F.count_if(F.col("type") == "BIRTH").alias("births"), F.count_if(F.col("type").isin("ARCHIVE", "OPEN_AT_END")).alias("ends")
    )
    return rows.unionByName(spans.filter("births <> 1 or ends <> 1").select("ref_id", F.lit("not one birth and one end").alias("rule")))


def movements(log: DataFrame) -> DataFrame:
    """One row for each movement: when it was born, known, usable, suspended and over."""
    at = lambda kind: F.min(F.when(F.col("type") == kind, F.col("t")))
    return log.filter("ref_id is not null").groupBy("series", "ref_id", "side").agg(
        at("BIRTH").alias("born"), at("P1_PUBLISHED").alias("known"), at("USABLE").alias("usable"), at("SUSPENSION").alias("suspended"),
        at("ARCHIVE").alias("ended"), F.max(F.when(F.col("type") == "ARCHIVE", F.col("reason"))).alias("reason"),
        F.count_if(F.col("type") == "CLOSE").alias("closes"),
    )


def judgement_at(log: DataFrame, t: int) -> DataFrame:
    """What each movement was held to be at a time, from the facts known by then."""
    known = log.filter((F.col("t") <= t) & F.col("ref_id").isNotNull())
    return known.groupBy("series", "ref_id").agg(F.max_by(F.struct("type", "condition", "t"), F.struct("t", "seq")).alias("x")).select(
        "series", "ref_id", "x.type", "x.condition", F.col("x.t").alias("since")
    )

