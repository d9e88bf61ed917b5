"""N-gram Jaccard join: exact links between word-shingle sets through a token-group matrix.

Two documents link when ``100 * |A & B| >= percent * |A | B|``. Equal sets form one class first.

1. Tokens. A set is cut into segments by hash, ``m`` of them in its size class, with ``m`` larger
   than the number of shingles in which two linked sets of that class can differ. A segment's hash is
   a token, so linked sets share a token, while a common passage alone hardly ever fills a segment.
   Sizes also tell how many tokens of a class they share at least; sets without so many tokens that
   any other set has are done.
2. Groups. A set follows the leader, the smallest set of one of its tokens, with which it shares most
   tokens, whether they link or not. Links with leaders are checked and give clusters; clusters that
   follow the same one are a group of similar documents, kept in parts of about ``PART_ROWS`` members.
   A cluster larger than that has parts of its own.
3. Sketches. Two parts meet where a rare token of a member is a rare token of a member of another
   cluster. What travels then is one bit an element or two: the parity of the elements that fall on each
   place. Places where two sketches are unlike are never more than elements that differ, so a pair of
   sets with too many of them can not link. A part is held once against many that ask.
4. The sets that this leaves are compared exactly, those of a part with all that ask it. Links that a
   group of sets already connects are not listed.

Members of one cluster are connected already, so pairs within it are never tried: a third of all
documents may be near copies of each other. Parts travel packed, so a family of similar texts that do
not link costs rows by its parts, not by its members, and elements travel only for sets with a sketch
like their own elsewhere. Tokens are combined before they are shuffled, so a frequent one sends one entry
per block of documents; they are computed on the way there and stored nowhere.

Defined results: null text, and text without words, has the empty set and links with nothing. A text
with fewer words than a shingle has its whole word sequence as its only element. Equal texts and
repeated rows share a class. Rows that repeat an id with other texts are rows of their own, linked by
their own texts. A row with a null id takes part; its component is the smallest id that is not null,
and null if there is none. Empty tables give no rows. Texts are read whole. Only the id and the text
are used of other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from corrag.llm.common import discard, mix, read_table, text_slices
from corrag.llm.components import components
from corrag.llm.shingles import BLOCK, shingle_sets
from corrag.session import TEXT_BATCH, staged

#: Ratio of the largest to the smallest size in a class.
SPAN = 1.5
#: Members of a part of a group, and their elements, on average.
PART_ROWS, PART_ELEMENTS = 256, 1 << 18
#: Sets that ask a part at once, on average.
ASKING_ROWS = 1024
#: Tokens that meet in one reducer block, for the number of buckets.
BUCKET_ROWS = 1 << 18
_LOW = np.int64((1 << 48) - 1)


def _bounds() -> list[int]:
    bounds = [1]
    while len(bounds) < 61:
        bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] * SPAN))))
    return bounds


#: The first size of each class.
BOUNDS = _bounds()


def differing(a, b, percent: int):
    """In how many elements two linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def class_segments(k: int, percent: int) -> tuple[int, int, int]:
    """Number of segments in a size class; the slack, how many of them are empty at most in nearly all
    sets; and the rest, of which linked sets share all but one for each element they differ in."""
    most = BOUNDS[k + 1] - 1
    base, slack = differing(most, most, percent) + 1, 2
    for _ in range(3):
        empty = np.exp(-most / SPAN / (base + slack)) * (base + slack)
        slack = int(np.ceil(empty + 4 * np.sqrt(empty))) + 2
    return base + slack, slack, base


def segment_tokens(elements: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set: in its own size class, and in the next if a linked set can be there.

    Empty segments give no token unless there are more of them than the slack, as only then every
    segment that two sets have in common could be empty. A token's last six bits are its class.
    """
    n = len(elements)
    if not n:
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(BOUNDS, n, "right")) - 1
    last = int(np.searchsorted(BOUNDS, n * 100 // percent, "right")) - 1
    mixed, tokens = mix(elements + np.uint64(0x632BE59BD9B4E019)), []
    for k in range(own, last + 1):
        m, slack, _ = class_segments(k, percent)
        at = ((elements >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        # The elements are sorted, so segments are runs.
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        sums[at[starts]] = np.add.reduceat(mixed, starts)
        filled = np.zeros(m, bool)
        filled[at[starts]] = True
        use = np.arange(m) if m - len(starts) > slack else np.flatnonzero(filled)
        token = mix(sums[use] ^ mix(use.astype(np.uint64) + np.uint64(k << 40)))
        tokens.append(token & ~np.uint64(63) | np.uint64(k))
    return np.concatenate(tokens)


def _described(batches, size: int):
    """(ids, sets) of slices of batches of (id, text)."""
    for batch in batches:
        for a, b, texts in text_slices(batch.column(1), BLOCK):
            yield batch.column(0).slice(a, b - a), shingle_sets(texts, size)


def _describe(size: int):
    """Batches of (id, text) to one row per document: id, n_shingles, two hashes of the set."""
    def run(batches):
        for ids, sets in _described(batches, size):
            keys = np.array([_set_key(s) for s in sets], np.int64)
            empty = np.array([not len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys[:, 0], mask=empty), pa.array(keys[:, 1], mask=empty)],
                names=["id", "n_shingles", "k1", "k2"])

    return run


def _about_tokens(percent: int):
    """Column: how many tokens a set of ``n_shingles`` elements has, about."""
    n = F.col("n_shingles")
    segments = F.array(*(F.lit(class_segments(i, percent)[0]) for i in range(len(BOUNDS) - 1)))
    own = F.size(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: b <= n)) - 1
    last = F.size(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: b <= n * 100 / percent)) - 1
    return F.when(n > 0, F.get(segments, own) + F.when(last > own, F.get(segments, last)).otherwise(0)).otherwise(0)


_PACKED = "bucket int, packed binary, token long, key long"


def _pack(tokens: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Twelve bytes each: the low 48 bits of the token, whose high bits choose the bucket, and the key."""
    both = np.stack((tokens.view(np.int64), keys), axis=1)
    return both.view(np.uint8).reshape(-1, 2, 8)[:, :, :6].reshape(-1, 12)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(packed) // 12, 2, 8), np.uint8)
    wide[:, :, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 2, 6)
    both = wide.reshape(-1, 16).view(np.int64)
    return both[:, 0], both[:, 1]


def _by_token(tokens: np.ndarray, keys: np.ndarray):
    """(tokens, keys, first of its token, token shared by different keys), sorted, without repetition."""
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, keys = tokens[fresh], keys[fresh]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    shared = ~first
    shared[:-1] |= shared[1:]
    return tokens, keys, first, shared


def _entries(tokens: np.ndarray, bucket, keys: np.ndarray):
    return pa.array(tokens.view(np.int64) & _LOW | np.int64(bucket) << np.int64(48)), pa.array(keys)


def _packed(size: int, percent: int, buckets: int):
    """Tokens of a block of documents, from batches of (id, text), dealt to buckets. Of a token that several have, one goes to the
    shuffle; all its entries are known to be shared and go along as they are."""
    def rows(bucket, packed, token, key):
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(packed, pa.binary()), token, key], names=["bucket", "packed", "token", "key"])

    def flush(held):
        tokens = np.frombuffer(b"".join(t for _, t in held), np.uint64)
        keys = np.repeat(np.array([k for k, _ in held], np.int64), [len(t) // 8 for _, t in held])
        tokens, keys, first, shared = _by_token(tokens, keys)
        at = (tokens >> np.uint64(33)).astype(np.int64) * buckets >> 31
        n = int(shared.sum())
        yield rows(keys[shared] % buckets, [None] * n, *_entries(tokens[shared], at[shared], keys[shared]))
        packed, at = _pack(tokens[first], keys[first]), at[first]  # tokens are sorted, so buckets are runs
        cuts = np.searchsorted(at, np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(cuts))
        nulls = pa.nulls(len(filled), pa.int64())
        yield rows(filled, [packed[cuts[i]:cuts[i + 1]].tobytes() for i in filled], nulls, nulls)

    def run(batches):
        held, total = [], 0
        for _, sets in _described(batches, size):
            for elements in sets:
                tokens = segment_tokens(elements, percent).tobytes()
                if tokens:
                    held.append((_set_key(elements)[0], tokens))
                total += len(tokens)
                if total > 8 << 20:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


def _meet(batches):
    """``token, key`` of tokens that several keys have; one bucket is held at a time."""
    def entries(bucket, held):
        tokens, keys, _, shared = _by_token(*_unpack(b"".join(held)))
        return pa.RecordBatch.from_arrays([*_entries(tokens[shared], bucket, keys[shared])], names=["token", "key"])

    now, held = None, []
    for batch in batches:
        known = batch.filter(batch.column(2).is_valid())
        yield pa.RecordBatch.from_arrays([known.column(2), known.column(3)], names=["token", "key"])
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now:
                if held:
                    yield entries(now, held)
                now, held = bucket, []
            if packed is not None:
                held.append(packed)
    if held:
        yield entries(now, held)


def _set_key(elements: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two hashes of a set, of 48 and of 64 bits."""
    one = np.sum(mix(elements), dtype=np.uint64) & np.uint64(_LOW)
    return one.view(np.int64), np.sum(mix(elements ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64).view(np.int64)


def _recompute(size: int):
    def run(batches):
        for ids, sets in _described(batches, size):
            ends = np.cumsum([len(s) for s in sets])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            keys = np.array([_set_key(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], names=["first", "k1", "k2", "elements"])

    return run


def _sets(texts: DataFrame, involved: DataFrame, size: int) -> DataFrame:
    """``rep, elements`` of the classes in ``involved``, from the rows that have a class's first id."""
    ids = involved.select("first").distinct()
    wanted = texts.join(ids, F.col("id").eqNullSafe(F.col("first")), "left_semi")
    found = wanted.mapInArrow(_recompute(size), "first long, k1 long, k2 long, elements array<long>")
    same = (found["k1"] == involved["k1"]) & (found["k2"] == involved["k2"]) & found["first"].eqNullSafe(involved["first"])
    rows = staged(found.join(involved, same).select("rep", "elements", "rows"), "elements", TEXT_BATCH)
    # Only a class of several rows can come more than once.
    once = rows.filter("rows = 1").drop("rows").unionAll(rows.filter("rows > 1").dropDuplicates(["rep"]).drop("rows"))
    sets = staged(once, "sets")
    discard(rows)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of set ids that link."""
    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("_x"))
    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("_y"))
    joined = pairs.join(left, "a").join(right, "b")
    sizes = F.size("_x") + F.size("_y")
    close = 100 * F.least(F.size("_x"), F.size("_y")) >= percent * F.greatest(F.size("_x"), F.size("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    return joined.filter(close & ((100 + percent) * common >= percent * sizes)).select("a", "b")


def _parted(sizes: DataFrame, links: DataFrame, near: DataFrame) -> DataFrame:
    """``rep, comp, part``: the cluster of every set, and the part of its group that holds it."""
    found = components(links).withColumnRenamed("node", "rep")
    members = staged(sizes.join(found, "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("comp")), "clusters")
    blocks = F.ceil(F.greatest(F.sum("count") / PART_ROWS, F.sum("n") / PART_ELEMENTS))
    clusters = members.groupBy("comp").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    clusters = clusters.withColumn("own", F.ceil(F.greatest(F.col("count") / PART_ROWS, F.col("n") / PART_ELEMENTS)))
    # A cluster follows the leader of its first set, or rather the cluster which that one is in.
    leaders = near.groupBy(F.col("a").alias("comp")).agg(F.max(F.struct("shared", -F.col("b"))).alias("_best"))
    leaders = leaders.select("comp", (-F.col("_best")["col2"]).alias("lead"))
    leaders = leaders.join(members.select(F.col("rep").alias("lead"), F.col("comp").alias("group")), "lead").select("comp", "group")
    grouped = staged(clusters.join(leaders, "comp", "left").withColumn("group", F.coalesce("group", "comp")), "led")
    pools = grouped.filter("own = 1").groupBy("group").agg(blocks.alias("pool"))
    placed = grouped.join(pools, "group", "left").select(
        "comp", "own", F.xxhash64("group", F.pmod(F.xxhash64("comp"), "pool")).alias("pooled"))
    part = F.when(F.col("own") > 1, F.xxhash64("comp", F.pmod(F.xxhash64("rep"), "own"), F.lit("own"))).otherwise(F.col("pooled"))
    parted = staged(members.join(placed, "comp").select("rep", "comp", part.alias("part")), "parts")
    discard(members, grouped)
    return parted


def _needed(percent: int):
    """Column: how many tokens of its class a set of ``n`` elements shares with any set it links with."""
    k = F.col("token").bitwiseAND(63).cast("int")
    base = F.get(F.array(*(F.lit(class_segments(i, percent)[2]) for i in range(len(BOUNDS) - 1))), k)
    largest = F.least(F.get(F.array(*(F.lit(b - 1) for b in BOUNDS[1:])), k), F.floor(F.col("n") * 100 / percent))
    apart = F.floor((F.col("n") + largest) * (100 - percent) / (100 + percent))
    return F.greatest(F.lit(1), base - apart)


def _promising(entries: DataFrame, percent: int) -> DataFrame:
    """The entries of sets that have enough shared tokens in some class to link with anything."""
    enough = (entries.groupBy("rep", _needed(percent).alias("need"), F.col("token").bitwiseAND(63).alias("k"))
              .agg(F.count("*").alias("have")).filter("have >= need").select("rep").distinct())
    return entries.join(enough, "rep")


def _near_leaders(entries: DataFrame, percent: int) -> DataFrame:
    """``a, b, shared, enough``: each set with those that are the smallest of its tokens, how many they
    share, and whether these are enough to link."""
    lead = entries.groupBy("token").agg(F.min("rep").alias("lead"))
    of_class = (entries.join(lead, "token").filter("rep != lead")
                .groupBy(F.col("rep").alias("a"), F.col("lead").alias("b"), _needed(percent).alias("need"), F.col("token").bitwiseAND(63).alias("k"))
                .agg(F.count("*").alias("shared")))
    return of_class.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max(F.expr("shared >= need")).alias("enough"))


def sketch(elements: np.ndarray, k: int) -> np.ndarray:
    """The parity of the elements on each place, packed to words; a power of two of places for the class."""
    places = max(64, 1 << int(BOUNDS[k + 1] - 1).bit_length())
    odd = np.bincount((mix(elements) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sketches(batches):
    """``rep, k, comp, part, elements`` to ``rep, k, comp, part, n, bits``."""
    for batch in batches:
        rep, k, comp, part, elements = (batch.column(i) for i in range(5))
        sets = [elements[i].values.to_numpy().view(np.uint64) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays(
            [rep, k, comp, part, pa.array([len(s) for s in sets], pa.int64()),
             pa.array([sketch(s, i).tobytes() for s, i in zip(sets, k.to_pylist())], pa.binary())],
            names=["rep", "k", "comp", "part", "n", "bits"])


def _asked(percent: int):
    """For a part and those that ask it: the sets of both sides with a sketch close to one of another cluster."""
    def run(table: pa.Table) -> pa.Table:
        parts, group = table.column("part").to_numpy(), table.column("gp")[0].as_py()
        sizes = [len(x) for x in table.column("members")]
        rows = table.column("members").combine_chunks().flatten()
        rep, comp, n = (rows.field(c).to_numpy() for c in ("rep", "comp", "n"))
        bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(rep), -1)
        held = np.repeat(parts == group, sizes)
        g, q = np.flatnonzero(held), np.arange(len(rep))
        if not table.column("self")[0].as_py():
            q = np.flatnonzero(~held)
        asking, met = [], np.zeros(len(g), bool)
        step = max(1, (1 << 20) // max(1, len(g) * bits.shape[1]))
        for at in range(0, len(q), step):
            some = q[at:at + step]
            most = (n[some][:, None] + n[g]) * (100 - percent) // (100 + percent)
            apart = np.bitwise_count(bits[some][:, None] ^ bits[g]).sum(axis=2, dtype=np.int64)
            close = (apart <= most) & (np.abs(n[some][:, None] - n[g]) <= most) & (comp[some][:, None] != comp[g])
            asking.append(some[close.any(axis=1)])
            met |= close.any(axis=0)
        asking = np.concatenate(asking) if asking else q[:0]
        reps, comps = (np.concatenate((x[asking], x[g[met]])) for x in (rep, comp))
        of_part = np.repeat([False, True], [len(asking), int(met.sum())])
        first = table.slice(0, 1)
        same = {c: pa.array(first.column(c).to_pylist() * len(reps), pa.int64()) for c in ("gp", "k", "slot")}
        return pa.table({**same, "rep": reps, "comp": comps, "held": of_part})

    return run


def _opened(percent: int):
    """For sets of a part and those that ask it: links between different clusters, as many as connect them."""
    def members(table):
        lists = table.column("elements").combine_chunks()
        return table.column("rep").to_numpy(), table.column("comp").to_numpy(), lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))

    def run(table: pa.Table) -> pa.Table:
        reps, comps, values, ends = members(table.filter(table.column("held")))
        q_reps, q_comps, q_values, q_ends = members(table.filter(pc.invert(table.column("held"))))
        sizes = np.diff(ends)
        order = np.argsort(values, kind="stable")
        ordered, owner = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        up: dict[int, int] = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        links = []
        for q, comp, a, b in zip(q_reps.tolist(), q_comps.tolist(), q_ends[:-1], q_ends[1:]):
            own = q_values[a:b]
            lo, hi = np.searchsorted(ordered, own), np.searchsorted(ordered, own, "right")
            if 100 * np.count_nonzero(hi > lo) < percent * len(own):
                continue  # the union of the part has too little of the set
            runs = hi - lo
            stops = np.cumsum(runs)
            common = np.bincount(owner[np.arange(stops[-1]) + np.repeat(lo - (stops - runs), runs)], minlength=len(sizes))
            for i in np.flatnonzero(((100 + percent) * common >= percent * (sizes + len(own))) & (comps != comp)):
                x, y = root(comp), root(int(comps[i]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((q, int(reps[i])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _cross_links(entries: DataFrame, sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different clusters, through the parts that meet in tokens and their sketches."""
    # Of the tokens that a set has to share, all but ``need - 1`` can be the more frequent ones: one of the
    # others, its rare tokens, is shared with every set it links with, and is rare there as well.
    k = F.col("token").bitwiseAND(63)
    of_set = ["rep", k]
    counted = entries.withColumns({
        "need": _needed(percent), "_df": F.count("*").over(Window.partitionBy("token"))})
    place = F.row_number().over(Window.partitionBy(*of_set).orderBy("_df", "token"))
    ranked = counted.withColumns({"_place": place, "_have": F.count("*").over(Window.partitionBy(*of_set))})
    rare = ranked.filter(F.col("_place") <= F.col("_have") - F.col("need") + 1).select("rep", "token")
    placed = staged(rare.join(members, "rep").select("rep", "token", "comp", "part"), "rare")
    cells = placed.groupBy("token", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    meeting = placed.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("token")
    met = staged(cells.join(meeting, "token"), "met")
    left = met.select("token", F.col("part").alias("qp"), F.col("lo").alias("_a"), F.col("hi").alias("_b"))
    right = met.select("token", F.col("part").alias("gp"), F.col("lo").alias("_c"), F.col("hi").alias("_d"))
    pairs = (left.join(right, "token").filter((F.col("qp") <= F.col("gp")) & (F.least("_a", "_c") < F.greatest("_b", "_d")))
             .select("qp", "gp", k.alias("k")).distinct())
    # By size class, the sketches of the members that have a token to meet with.
    asking = placed.join(meeting, "token").select("rep", k.alias("k"), "comp", "part").distinct()
    drawn = asking.join(sets, "rep").select("rep", "k", "comp", "part", "elements").mapInArrow(
        _sketches, "rep long, k long, comp long, part long, n long, bits binary")
    rows = staged(drawn.groupBy("part", "k").agg(
        F.collect_list(F.struct("rep", "comp", "n", "bits")).alias("members"), F.count("*").alias("count")), "sketches", TEXT_BATCH)
    # Those that ask a part come in slots; a part that asks itself has one of its own.
    counted = pairs.join(rows.select(F.col("part").alias("qp"), "k", "count"), ["qp", "k"])
    of_part = counted.filter("qp < gp").groupBy("gp", "k").agg(F.ceil(F.sum("count") / ASKING_ROWS).alias("slots"))
    dealt = staged(counted.join(of_part, ["gp", "k"], "left").select(
        "qp", "gp", "k", F.when(F.col("qp") < F.col("gp"), F.pmod(F.xxhash64("qp"), "slots")).otherwise(F.lit(-1)).alias("slot")), "pairs")
    one = ["gp", "k", "slot"]
    sides = (dealt.filter("qp < gp").select(F.col("qp").alias("part"), *one)
             .unionAll(dealt.select(F.col("gp").alias("part"), *one).distinct())
             .join(rows, ["part", "k"]).select(*one, "part", "members", (F.col("slot") < 0).alias("self")))
    close = staged(sides.groupBy(*one).applyInArrow(_asked(percent), "gp long, k long, slot long, rep long, comp long, held boolean"), "close")
    links = staged(close.join(sets, "rep").groupBy(*one).applyInArrow(_opened(percent), "a long, b long"), "cross-links")
    discard(placed, met, rows, dealt, close)
    return links


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), class_id
    (smallest id with the same set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = staged(texts.mapInArrow(_describe(size), "id long, n_shingles long, k1 long, k2 long"), "sets", TEXT_BATCH)
    classes = staged(rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("first"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")

    n_tokens = rows.agg(F.coalesce(F.sum(_about_tokens(percent)), F.lit(0))).first()[0]
    buckets = int(min(1 << 14, max(8, 1 << int(np.ceil(np.log2(n_tokens / BUCKET_ROWS + 1))))))
    shared = (texts.mapInArrow(_packed(size, percent, buckets), _PACKED)
              .repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "token long, key long").distinct())
    entries = staged(shared.join(classes.select(F.col("k1").alias("key"), "rep", "n"), "key").drop("key"), "shared-tokens", TEXT_BATCH)

    kept = staged(_promising(entries, percent), "entries")
    sizes = staged(kept.select("rep", "n").distinct(), "involved")
    sets = _sets(texts, classes.join(sizes.select("rep"), "rep", "left_semi"), size)
    near = staged(_near_leaders(kept, percent), "near-leaders")
    links = staged(_verified(near.filter("enough").select("a", "b"), sets, percent), "group-links")
    members = _parted(sizes, links, near)
    across = _cross_links(kept, sets, members, percent)
    found = components(links.unionAll(across))
    # Sets have numbers; a component is named by the smallest id in it.
    nodes = found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
    linked = staged(nodes.join(classes.select(F.col("rep").alias("node"), "first"), "node"), "linked")
    names = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(names, "component").select(F.col("node").alias("rep"), "component_id")
    of_class = staged(classes.join(named, "rep", "left").select("k1", "k2", "first", F.coalesce("component_id", "first").alias("component_id")), "named")
    result = staged(rows.select("id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("id")).alias("class_id")), "components")
    discard(rows, classes, entries, kept, sizes, sets, near, links, members, across, found, linked, of_class)
    return result


def query_ngram_join(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents"))
