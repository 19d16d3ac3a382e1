"""Shards of near equal bytes that keep linked documents together: balanced label propagation.

Documents that share a link key are neighbours.  Linked documents start on shards drawn by a hash of their id, which
knows nothing of keys.  Each round joins the documents with their keys' bytes per shard: a key wants its members on
the shard that holds most of it, or on as many as it needs if it is larger than a shard; a document follows the keys
that weigh most.  The quota bounds a shard's net flow: full shards swap, and small keys that lie on one shard make way as wholes for
those who gain by coming.  Where more wants in than may, lots decide, one for all members of a small key.
After the rounds whole keys leave shards above the quota; they and the documents without links fill all shards up.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, remove, scratch

#: Documents above this part of a shard are dealt one by one, largest first: fewer than shards * BIG of them exist.
BIG = 200
#: While documents move, shards may hold this part of the quota above it; the end brings all below it again.
SLACK = 10
#: A key fills at most this many hundredths of a shard, and is small below this part of the quota: its members then move as one.
FILL, SMALL = 90, 20
LOTS = 1 << 40
#: Rows that one bucket of the running sums holds, about.
BUCKET_ROWS = 20_000
NO_ID = -(1 << 63)


def running(df: DataFrame, keys: list[str], bucket: Column, value: Column, order: list, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one within ``keys``, without gathering a key in one task."""
    df = df.withColumns({"_b": bucket, "_v": value})
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(starts, [*keys, "_b"])
    return df.withColumn(name, F.col("_o") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_b", "_v", "_o")


def _loads(df: DataFrame, shards: int) -> list[int]:
    """Bytes per shard; one row a shard comes to the driver."""
    got = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("size")).collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def _pick(values: list, by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), by)


def lot(*what: Column) -> Column:
    return F.pmod(F.xxhash64(*what), F.lit(LOTS))


def flows(load: list[int], cap: int, wished: dict[tuple[int, int], int], spare: list[int]) -> tuple[dict, dict]:
    """How many of each (from, to)'s ``wished`` bytes may move, and how many ``spare`` bytes make way, by (from, to).

    No shard's net flow takes it above ``cap``.  Circles of wishes go first, from swaps to longer ones; then what free room
    takes in, from the shards nothing leads on from to those behind them; then wishes for whose bytes as many spare ones, which
    lose nothing by it, go the other way.  Every circle uses up a wish, of which there are less than one a pair of shards.
    """
    left: dict[int, dict[int, int]] = {s: {} for s in range(len(load))}
    for (a, b), w in sorted(wished.items()):
        left[a][b] = w
    granted, ways, done = dict.fromkeys(wished, 0), {}, []

    def grant(a: int, b: int, n: int) -> None:
        granted[a, b] += n
        left[a][b] -= n
        if not left[a][b]:
            del left[a][b]

    def circle(nodes: list[int]) -> None:
        steps = list(zip(nodes, [*nodes[1:], nodes[0]], strict=True))
        n = min(left[a][b] for a, b in steps)
        for a, b in steps:
            grant(a, b, n)

    for a, b in sorted(wished):
        if a < b and b in left[a] and a in left[b]:
            circle([a, b])
    for start in left:
        path = [start] if start not in done else []
        while path:
            ahead = {b: n for b, n in left[path[-1]].items() if b not in done}
            if not ahead:
                done.append(path.pop())
            elif (to := max(ahead, key=lambda b: (ahead[b], -b))) in path:
                at = path.index(to)
                circle(path[at:])
                path = path[: at + 1]
            else:
                path.append(to)
    room = [cap - x for x in load]
    for b in done:  # all wishes left lead to shards that come before in this order
        for a in sorted(left, key=lambda a: (-left[a].get(b, 0), a)):
            if (n := min(left[a].get(b, 0), room[b])) > 0:
                grant(a, b, n)
                room[a] += n
                room[b] -= n
    spare = list(spare)
    for n, a, b in sorted(((n, a, b) for a, to in left.items() for b, n in to.items()), reverse=True):
        if (n := min(n, spare[b])) > 0:
            grant(a, b, n)
            ways[b, a] = n
            spare[b] -= n
    return granted, ways


def wants(votes: DataFrame, shards: int, quota: int) -> DataFrame:
    """Per (key, shard) of ``votes``: bytes ``here``, whether members ``stay``, the ``goals`` of those that don't, ``small``, and ``alone`` for small keys that have no other shard.

    A key's shards are ranked by its bytes on them.  Members stay on the first ones that it needs; the others may go to
    the first ones that rank above their own.  At most ``shards`` entries a key are gathered.
    """
    entry = F.struct((-F.col("bytes")).alias("less"), F.xxhash64("key", F.col("shard").cast("long")).alias("tie"), "shard")
    ranked = votes.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("ranked"), F.sum("bytes").alias("whole"))
    cap = quota * FILL // 100 + 1
    need = F.least(F.lit(shards), F.floor((F.col("whole") + cap - 1) / cap).cast("int"))
    ranked = ranked.select("key", "ranked", need.alias("need"), (F.col("whole") * SMALL <= quota).alias("small"))
    places = ranked.select("key", "ranked", "need", "small", F.posexplode("ranked").alias("place", "own"))
    goals = F.transform(F.slice("ranked", 1, F.least("place", "need")), lambda x: F.struct(x["shard"].alias("shard"), (-x["less"]).alias("bytes")))
    return places.select("key", F.col("own.shard").alias("shard"), (-F.col("own.less")).alias("here"), (F.col("place") < F.col("need")).alias("stay"), goals.alias("goals"), "small", (F.col("small") & (F.size("ranked") == 1)).alias("alone"))


def propagate(state: DataFrame, links: DataFrame, shards: int, quota: int, rounds: int, log: list | None = None) -> DataFrame:
    """Moves ``state(rid, size, shard)`` along ``links(rid, key)`` until the rounds are over or nobody moves.

    ``log`` gets for each round the cut (over all keys, shards beyond the first) before it, and the documents moved.
    """
    spark, root = state.sparkSession, scratch(state.sparkSession, "rounds")
    cap = quota + quota // SLACK
    for step in range(rounds):
        at = f"{root}/{step}"
        load = _loads(state, shards)
        member = links.join(state, "rid")
        votes = cut(member.groupBy("key", "shard").agg(F.sum("size").alias("bytes")), f"{at}/votes")
        plan = cut(wants(votes, shards, quota), f"{at}/plan")  # as a table, so that a join on large keys can be split
        goal = F.get("goals", F.pmod(F.xxhash64(F.lit(step).cast("long"), F.col("rid")), F.size("goals")).cast("int"))
        goal = F.when(~F.col("stay") & (F.size("goals") > 0), goal)
        ticket = lot(F.lit(step).cast("long"), F.when(F.col("small"), F.col("key")).otherwise(F.col("rid")))
        said = member.join(plan, ["key", "shard"]).select("rid", "size", "shard", "alone", ticket.alias("ticket"), F.coalesce(goal, F.struct("shard", (F.col("here") - F.col("size")).alias("bytes"))).alias("goal"))
        sums = said.groupBy("rid", F.col("goal.shard").alias("to")).agg(F.sum("goal.bytes").alias("bytes"), F.first("size").alias("size"), F.first("shard").alias("shard"), F.min("ticket").alias("ticket"), F.min("alone").alias("alone"), F.count("*").alias("n"))
        best = F.max(F.struct("bytes", (F.col("to") == F.col("shard")).alias("same"), (-F.col("to")).alias("less"), "ticket", "size", "shard"))
        wish = sums.groupBy("rid").agg(best.alias("b"), (F.min("alone") & (F.sum("n") == 1)).alias("spare")).where("spare or not b.same")
        wish = cut(wish.select("rid", (-F.col("b.less")).alias("to"), "b.ticket", "b.size", "b.shard"), f"{at}/wish")  # a spare one wishes to stay
        asked = {(r[0], r[1]): r[2] for r in wish.groupBy("shard", "to").agg(F.sum("size")).collect()}  # one row a pair of shards
        spare = [asked.pop((s, s), 0) for s in range(shards)]
        granted, ways = flows(load, cap, asked, spare)
        below = [granted[a, b] * LOTS // asked[a, b] if (a, b) in asked else 0 for a in range(shards) for b in range(shards)]
        to = F.when(F.col("to") != F.col("shard"), F.when(F.col("ticket") < _pick(below, F.col("shard") * shards + F.col("to")), F.col("to")))
        for s in range(shards):  # tickets below the first sum go to the first shard that spare ones make way to, and so on
            first, given = 0, sorted((b, n) for (a, b), n in ways.items() if a == s)
            for b, n in given:
                first += n
                to = to.when((F.col("shard") == s) & (F.col("ticket") < first * LOTS // spare[s]), F.lit(b))
        goes = wish.select("rid", to.alias("to")).where("to is not null")
        moved = cut(state.join(goes, "rid", "left").select("rid", "size", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved")), f"{root}/state{step}")
        n = moved.where("moved").count() if asked else 0
        if log is not None:
            log.append({"cut": votes.count() - votes.select("key").distinct().count(), "moved": n})
        remove(spark, at, *([f"{root}/state{step - 1}"] if step else []))
        state = moved.drop("moved")
        if not n:
            break
    return state


def shard_documents(docs: DataFrame, links: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 5, overhead: int = 16, log: list | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``size`` (UTF-8 bytes and ``overhead``), ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and ``grown_shard`` (null).

    ``links(doc_id, key)``: documents with a key in common belong together; by default equal texts do.  Sizes of
    shards differ by little more than a two-hundredth of a shard, or by one document where documents are larger
    than that.  Null text counts as empty; a null id is a value like any other.  Rows that repeat an id are placed
    together.  Other columns are ignored; an empty table gives no rows; ties fall by hash, the same in each run.
    ``log`` gets what each round of the propagation did.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(5)).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    base = cut(base.withColumn("rid", F.coalesce("doc_id", F.lit(NO_ID))))
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    quota = max(1, -(-total // shards))
    whole = base.groupBy("rid").agg(F.sum("size").alias("size"))
    if links is None:
        groups = cut(base.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1"))  # as a table, so that a join on large groups can be split
        keyed = base.join(groups, ["t1", "t2"]).select("rid", F.xxhash64("t1", "t2").alias("key"))
    else:
        keyed = links.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("rid"), F.xxhash64("key").alias("key"))
    keyed = cut(keyed.distinct())
    linked = keyed.select("rid").distinct()
    start = F.pmod(F.xxhash64(F.lit(17).cast("long"), F.col("rid")), F.lit(shards)).cast("int")
    state = cut(whole.join(linked, "rid").select("rid", "size", start.alias("shard")))
    state = propagate(state, keyed, shards, quota, rounds, log)

    load = _loads(state, shards)
    buckets = max(1, n // BUCKET_ROWS)
    unit, leaving = F.xxhash64("rid"), None
    if max(load) > quota:
        weight = keyed.join(whole, "rid").groupBy("key").agg((F.sum("size") * SMALL <= quota).alias("small"))
        main = keyed.join(cut(weight), "key").groupBy("rid").agg(F.min(F.struct("small", "key")).alias("m"))
        crowd = state.where(_pick([x > quota for x in load], F.col("shard"))).join(main, "rid")
        crowd = crowd.select("rid", "size", "shard", F.when(F.col("m.small"), F.col("m.key")).otherwise(F.xxhash64("rid")).alias("unit"), F.col("m.small").alias("small"))
        # small keys come last, hence leave first; they stay or leave as one, but for one a shard
        bucket = F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int") + F.when(F.col("small"), buckets).otherwise(0)
        leaving = running(crowd, ["shard"], bucket, F.col("size"), ["unit", "rid"], "place").where(F.col("place") + F.col("size") > quota)
        leaving = cut(leaving.select("rid", "unit"))
        state = cut(state.join(leaving, "rid", "left_anti"))
        load = _loads(state, shards)
    pool = whole.join(state.select("rid"), "rid", "left_anti")
    if leaving is not None:
        pool, unit = pool.join(leaving, "rid", "left"), F.coalesce("unit", unit)
    pool = cut(pool.withColumn("unit", unit))
    big = pool.where(F.col("size") > quota // BIG).select("rid", "size").collect()  # fewer than shards * BIG rows
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    dealt = []
    for rid, size in sorted(big, key=lambda r: (-r[1], r[0])):
        x, s = heap[0]
        heapq.heapreplace(heap, (x + size, s))
        dealt.append((rid, s))
    for x, s in heap:
        load[s] = x
    dealt = docs.sparkSession.createDataFrame(dealt, "rid long, shard int")

    rest = pool.where(F.col("size") <= quota // BIG)
    room = [max(0, quota - x) for x in load]
    small = max(1, int(total) - sum(load))
    bounds, at = [], 0
    for x in room[:-1]:
        at += x
        bounds.append(at * small // max(1, sum(room)))
    bucket = F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int")
    rest = running(rest.withColumn("one", F.lit(0)), ["one"], bucket, F.col("size"), ["unit", "rid"], "place")
    where = sum((F.when(F.col("place") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    placed = state.select("rid", "shard").unionByName(rest.select("rid", where.cast("int").alias("shard"))).unionByName(pool.select("rid").join(F.broadcast(dealt), "rid"))
    out = base.join(placed, "rid")
    out = running(out, ["shard"], F.pmod(F.xxhash64("rid"), F.lit(max(1, buckets // shards))).cast("int"), F.lit(1), ["rid", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
